"""The dealt operators applied to whole tables, and their checking SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import bytebpe, decontam, directcodes, divergence, interpolation, merkle, near, packing, pii, quality, repeats, topk, urls

RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality.share(F.col("doc_id"), 3) == 1
    model = quality.fit(quality.sample(docs, _table(spark, sf_dir, "labels").where(~held_out)))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontam.index(_table(spark, sf_dir, "documents"))
    found = decontam.search(index, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: URLs of the pages whose number is labelled toxic."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id")).distinct()
    listed = pages.join(toxic, "page_id", "left_semi").select("url")
    return urls.judge(pages, RULES, listed)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op8_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remainder 2 is held out; remainder 3 is the deleted part of the training texts."""
    part = quality.share(F.col("doc_id"), 7)
    kind = F.when(part == 2, interpolation.UNSEEN).when(part == 3, interpolation.DELETED)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return interpolation.score(docs, F.coalesce(kind, F.lit(interpolation.RETAINED)))


def op9_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = directcodes.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return directcodes.read_back(shards)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors.where("vec_id % 100 = 0"), vectors)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later rows: where 3 divides the checksum of doc_id, the text's A-Z are lower-cased."""
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    later = F.when(touched, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    return merkle.prove(_table(spark, sf_dir, "documents"), now={"text": later})


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    described = bytebpe.shared(spark, ranks, public_tokenizers.PATTERN)
    decoded = bytebpe.decode(bytebpe.encode(_table(spark, sf_dir, "documents"), described), described, texts=False)
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_repeats, op3_quality, op4_decontamination, op5_near_duplicates, op6_url_filter, op7_packing,
        op8_interpolation, op9_token_codes, op10_top_k, op11_manifest,
        op12_source_divergence, op13_byte_bpe,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _leaf_sql(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    counted = [f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen(CAST({f} AS VARCHAR)) || ':' || {f} END" for f in fields]
    return f"sha256({' || '.join(counted)})"


def _levels_sql(name: str, start: str, levels: int) -> str:
    """Views of a forest: ``name``_k has each node of level k with its siblings and its tree's size there."""
    views, nodes = [], start
    for k in range(levels):
        run = "PARTITION BY tree, idx // 8 ORDER BY idx ROWS BETWEEN"
        views.append(f"""{name}_{k} AS (
            SELECT *, count(*) OVER (PARTITION BY tree) AS size,
                   coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                   coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
            FROM ({nodes}))""")
        nodes = f"""SELECT tree, idx // 8 AS idx, CASE WHEN any_value(size) > 1 THEN sha256(string_agg(digest, '' ORDER BY idx))
            ELSE any_value(digest) END AS digest FROM {name}_{k} GROUP BY tree, idx // 8"""
    return ", ".join([*views, f"{name}_top AS ({nodes})"])


def _walk_sql(name: str, rows: str, levels: int) -> str:
    """``rows`` (tree, idx, folded, proof) after every level of ``name``."""
    for k in range(levels):
        rows = f"""SELECT w.* REPLACE (w.idx // 8 AS idx,
            CASE WHEN size > 1 THEN sha256(before || folded || after) ELSE folded END AS folded,
            CASE WHEN size > 1 THEN proof || before || after ELSE proof END AS proof)
            FROM ({rows}) w JOIN {name}_{k} n ON n.tree = w.tree AND n.idx = w.idx"""
    return rows


def _manifest_sql(levels: int = 8, lang_levels: int = 4) -> str:
    lowered = f"translate(text, '{_UPPER}', '{_LOWER}')"
    bits = "list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, x: xor(c >> 8, crcs.t[(xor(c, x) & 255) + 1])), 4294967295)"
    up = _walk_sql("leafs", "SELECT doc_id, tree, idx, leaf, later AS folded, '' AS proof FROM placed", levels)
    joined = "SELECT doc_id, s.tree, s.idx, leaf, s.digest AS subroot, folded, proof FROM up u JOIN subroots s ON s.lang_tree = u.tree"
    return f"""
        WITH crcs AS (SELECT list({bits} ORDER BY b) AS t FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))),
        leaves AS (
            SELECT doc_id, coalesce('+' || lang, '') AS tree, {_leaf_sql("text")} AS leaf,
                   CASE WHEN coalesce({crc} % 3 = 0, false) THEN {_leaf_sql(lowered)} ELSE {_leaf_sql("text")} END AS later
            FROM documents, crcs),
        placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
        {_levels_sql("leafs", "SELECT tree, idx, leaf AS digest FROM placed", levels)},
        subroots AS (SELECT tree AS lang_tree, 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, digest FROM leafs_top),
        {_levels_sql("langs", "SELECT tree, idx, digest FROM subroots", lang_levels)},
        up AS ({up}),
        over_all AS ({_walk_sql("langs", joined, lang_levels)})
        SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified
        FROM over_all, langs_top
    """


_REST = "CASE WHEN instr(url, '://') > 0 THEN regexp_extract(url, '(?s)^.*?://(.*)$', 1) ELSE '' END"
ORACLE = {
    "op6_url_filter": f"""
        WITH cut AS (SELECT page_id, coalesce({_REST}, '') AS rest FROM pages),
        named AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        known AS (
            SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') END AS canonical
            FROM named),
        listed AS (
            SELECT DISTINCT canonical FROM known
            WHERE canonical IS NOT NULL AND page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
        ruled AS (
            SELECT *, CASE
                WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
                WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
                WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
                WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
                WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule
            FROM known)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                    WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
               l.canonical IS NOT NULL AS listed
        FROM ruled LEFT JOIN listed l ON ruled.canonical = l.canonical
    """,
    "op10_top_k": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op11_manifest": _manifest_sql(),
    "op12_source_divergence": """
        WITH docs AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents),
        words AS (
            SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
        sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        counted AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        totals AS (SELECT lang, source, sum(n) AS n FROM counted GROUP BY ALL),
        sources AS (
            SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(n, 0) AS total
            FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes USING (lang) LEFT JOIN totals USING (lang, source)),
        shares AS (
            SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
                   1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // CAST(s.total + 5 * s.v AS HUGEINT) AS p
            FROM sources s JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)),
        everywhere AS (
            SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // CAST(sum(n) OVER (PARTITION BY lang) + 5 * v AS HUGEINT) AS q
            FROM (SELECT lang, term, sum(n) AS n FROM counted GROUP BY ALL) JOIN sizes USING (lang)),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item,
                   coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y USING (lang, term)
                             WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
            FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source),
        terms AS (
            SELECT lang, source, term AS item, p - q AS value FROM shares JOIN everywhere USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (
            SELECT lang, source, 'pair' AS part, item, value,
                   row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
            UNION ALL
            SELECT lang, source, 'term', item, value,
                   row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
}
