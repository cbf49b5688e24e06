"""The registered queries of the operators: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.materialize import materialize, scratch_path
from . import chat, decontaminate, jaccard, language, lines, negatives, neighbours, packing, pieces, tokencount, tokenfile, turntrie, urls
from .rows import ROW, keep_keys, look_up, with_rows

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"

# The rules that the pages are judged by.
RULES = (
    urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/"),
)


def _read(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train_language(docs.filter(~language.is_held_out(F.col("doc_id"))))
    judged = model.predict(docs.select("doc_id", "text"))
    return judged.select("doc_id", language.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_neighbours(spark, sf_dir):
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_packing(spark, sf_dir):
    pieces = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_jaccard(spark, sf_dir):
    return jaccard.jaccard_classes(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


def op5_tokenfile(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    tokenfile.write_tokens(_read(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return tokenfile.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_tokencount(spark, sf_dir):
    return tokencount.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_lines(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "text", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"))


def op8_urls(spark, sf_dir):
    return urls.judge_urls(_read(spark, sf_dir, "pages"), RULES)


def op9_chat(spark, sf_dir):
    return chat.render_chats(_read(spark, sf_dir, "conversations"))


def op10_decontaminate(spark, sf_dir):
    docs = with_rows(_read(spark, sf_dir, "documents").select("doc_id", "text"), "docs")
    found = materialize(decontaminate.find_leaks(docs, _read(spark, sf_dir, "benchmark")), "found")
    return look_up(docs.select(ROW, "doc_id"), found, ROW).select("doc_id", "item_id", "score", "first_word", "end_word")


def op11_pieces(spark, sf_dir):
    path = public_tokenizers.path(PIECES)
    ids = pieces.encode_pieces(_read(spark, sf_dir, "documents"), path)
    texts = pieces.decode_pieces(ids, path)
    return texts.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, with their order ``section, no, turn``, and the conversations left without any.

    A conversation's first h turns are replaced by the first h of the first conversation of its twenty.
    """
    rows = with_rows(turns.filter("conv_id IS NOT NULL"), "turns")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_id", ROW))
    first = materialize(rows.withColumn("no", place.cast("long") - 1).filter("no < 4"), "first-turns")  # of each task before they are shuffled
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    own = first.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("base", F.expr("conv_id - conv_id % 20"))
    own = materialize(own, "conversations")
    gone = materialize(first.withColumn("h", h).filter("no < h").select(ROW), "replaced-turns")
    tails = keep_keys(rows, gone, ROW, keep=False).select("conv_id", F.lit(1).alias("section"), F.lit(0).cast("long").alias("no"), "turn", "turn_id", "words")
    base = first.select(F.col("conv_id").alias("base"), "no", "turn", "turn_id", "words")
    heads = own.filter("h > 0").select("conv_id", "h", "base").join(base, "base").filter("no < h")
    heads = heads.select("conv_id", F.lit(0).alias("section"), "no", "turn", "turn_id", "words")
    turnless = own.filter("n <= h").join(own.select(F.col("conv_id").alias("base")), "base", "left_anti").select("conv_id")
    return heads.unionByName(tails), turnless


def op12_turntrie(spark, sf_dir):
    turns, turnless = _rebuilt(turntrie.turn_ids(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return turntrie.turn_trie(turns, order=("section", "no", "turn"), turnless=turnless)


def op13_negatives(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language, op2_neighbours, op3_packing, op4_jaccard, op5_tokenfile, op6_tokencount, op7_lines, op8_urls, op9_chat, op10_decontaminate,
        op11_pieces, op12_turntrie, op13_negatives,
    )
}

# What SQL can express. Tokenizers, trained profiles, SimHash and alignment it cannot: those are tested in tests/llm.
ORACLES = {
    "op2_neighbours": r"""
        WITH v AS (
            SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
        ), r AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score,
                row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, c.e), c.vec_id) AS rank
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op4_jaccard": r"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
        w AS (SELECT r, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10ffff}]+') AS w FROM d),
        s AS (
            SELECT r, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END)) AS g
            FROM w
        ),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
        l AS (SELECT p.a, p.b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b WHERE 5 * p.c >= 4 * (x.n + y.n - p.c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach(r, m) AS (SELECT r, r FROM d UNION SELECT e.b, reach.m FROM reach JOIN e ON e.a = reach.r),
        c AS (SELECT reach.r, min(o.doc_id) AS class_id FROM reach JOIN d o ON o.r = reach.m GROUP BY reach.r),
        k AS (SELECT a AS r, count(*) AS links FROM e GROUP BY a)
        SELECT d.doc_id, c.class_id, coalesce(k.links, 0)::BIGINT AS links FROM d JOIN c ON c.r = d.r LEFT JOIN k ON k.r = d.r""",
    "op8_urls": r"""
        WITH RECURSIVE u AS (
            SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
                coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '') AS query
            FROM pages
        ), p AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node FROM u),
        rules(rule, h, q, verdict) AS (
            VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
                ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
        ),
        found AS (
            SELECT node, host, path, unnest([
                regexp_extract(regexp_extract(html, '(?i)<link\s[^>]*rel\s*=\s*["'']?canonical["''\s/>][^>]*>?'), '(?i)\shref\s*=\s*["'']?([^"''\s>]*)', 1),
                regexp_extract(regexp_extract(html, '(?i)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh["''\s/>][^>]*>?'), '(?i)\scontent\s*=\s*["''][^"'';,]*[;,]\s*(?:url\s*=\s*)?([^"''\s>]*)', 1)
            ]) AS found
            FROM p
        ),
        refs AS (SELECT node, host, path, replace(regexp_replace(found, '#.*$', ''), '&amp;', '&') AS ref FROM found WHERE found <> ''),
        full_refs AS (
            SELECT *, CASE WHEN starts_with(ref, '//') THEN 'x:' || ref WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN ref END AS far FROM refs WHERE ref <> ''
        ),
        edges AS (
            SELECT node AS a, CASE
                WHEN far IS NOT NULL THEN CASE WHEN regexp_extract(far, '(?s)^.*?://([^/?#]*)', 1) <> '' THEN
                    translate(regexp_extract(far, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                    || CASE WHEN regexp_extract(far, '(?s)^.*?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(far, '(?s)^.*?://[^/?#]*([^?#]*)', 1) END
                    || regexp_extract(far, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) END
                WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') OR host = '' THEN NULL
                WHEN starts_with(ref, '/') THEN host || ref
                WHEN starts_with(ref, '?') THEN host || CASE WHEN path = '' THEN '/' ELSE path END || ref
                ELSE host || CASE WHEN regexp_extract(path, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)', 1) END || ref END AS b
            FROM full_refs
        ),
        both_ways AS (SELECT a, b FROM edges WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM edges WHERE a IS NOT NULL AND b IS NOT NULL),
        nodes AS (SELECT a AS node, split_part(a, '/', 1) AS host, regexp_extract(a, '(?s)^[^/]*([^?]*)', 1) AS path FROM both_ways GROUP BY a),
        bad(node) AS (
            SELECT node FROM (
                SELECT n.node, r.verdict, row_number() OVER (PARTITION BY n.node ORDER BY length(r.rule) DESC) AS k
                FROM nodes n JOIN rules r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.q)
            ) x WHERE k = 1 AND verdict = 'block'
            UNION SELECT e.b FROM bad JOIN both_ways e ON e.a = bad.node
        ),
        own AS (
            SELECT page_id, host, path, node,
                (SELECT max_by(r.rule, length(r.rule)) FROM rules r WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q)) AS rule
            FROM p
        )
        SELECT own.page_id, own.host, own.path, own.rule,
            CASE WHEN own.rule IS NOT NULL THEN r.verdict WHEN own.node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END AS verdict
        FROM own LEFT JOIN rules r ON r.rule = own.rule""",
    "op9_chat": r"""
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn) AS l FROM t GROUP BY conv_id),
        p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)),
        m AS (SELECT min(conv_id) AS conv_id, l FROM c GROUP BY l)
        SELECT conv_id, len(l)::BIGINT AS n_turns, array_to_string(['<|im_start|>' || x.r || chr(10)
            || regexp_replace(x.t, '<\|(im_start|im_end)\|>', '< |\1|>', 'g') || '<|im_end|>' || chr(10) for x in l], '') AS text
        FROM m ANTI JOIN p ON m.l = p.l""",
    "op12_turntrie": r"""
        WITH RECURSIVE digits AS (
            SELECT conv_id, flatten([[(ascii(d) >> i) & 1 for i in range(0, 8)] for d in string_split(conv_id::VARCHAR, '')]) AS bits
            FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
        ),
        own AS (
            SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, bits::BIGINT[]),
                lambda a, b: xor(a >> 1, CASE WHEN (xor(a, b) & 1) = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) % 4 AS h
            FROM digits
        ),
        t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS no
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        turns AS (
            SELECT o.conv_id, 0 AS section, t.no, t.role, t.text FROM own o JOIN t ON t.conv_id = o.base AND t.no < o.h
            UNION ALL SELECT o.conv_id, 1, t.no, t.role, t.text FROM own o JOIN t ON t.conv_id = o.conv_id AND t.no >= o.h
        ),
        ids AS (SELECT role, text, row_number() OVER () AS id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM (SELECT DISTINCT role, text FROM turns)),
        c AS (
            SELECT o.conv_id, coalesce(list(i.id ORDER BY x.section, x.no) FILTER (i.id IS NOT NULL), []) AS l
            FROM own o LEFT JOIN turns x ON x.conv_id = o.conv_id LEFT JOIN ids i ON i.role = x.role AND i.text = x.text GROUP BY o.conv_id
        ),
        m AS (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS depth FROM c),
        n AS (
            SELECT l[1:depth] AS s, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(l) = depth), '')) AS ends_sha256
            FROM m GROUP BY 1, 2
        ),
        kids AS (SELECT s[1:depth - 1] AS s, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
        f AS (
            SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n.n_convs - 1) * coalesce(i.words, 0) AS saved
            FROM n LEFT JOIN kids k ON k.s = n.s LEFT JOIN ids i ON i.id = n.s[n.depth]
        ),
        below AS (
            SELECT s[1:k] AS s, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
            FROM (SELECT s, leaf, saved, unnest(range(0, depth + 1)) AS k FROM f) GROUP BY 1
        )
        SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, b.saved_tokens, f.ends_sha256
        FROM f JOIN below b ON b.s = f.s LEFT JOIN n p ON f.depth > 0 AND p.s = f.s[1:f.depth - 1]""",
    "op13_negatives": r"""
        WITH v AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        ),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
        ),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ),
        n AS (
            SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
        )
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
