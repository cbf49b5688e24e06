"""Focused page relevance as Spark jobs over tables and streams of fetched pages."""

from .operators.oneclass import OneClassModel, load_model, save_model
from .operators.sentences import TextSettings
from .plans.crawl import CrawlConfig, FocusedCrawl, train
from .sources.state import CrawlStore

__all__ = ["CrawlConfig", "CrawlStore", "FocusedCrawl", "OneClassModel", "TextSettings", "load_model", "save_model", "train"]
