"""Registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from public_tokenizers import PATTERN
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.llm import (
    bpe_tree,
    decontaminate,
    grace_dedup,
    kdtree,
    language,
    line_dedup,
    manifest,
    packing,
    periodic,
    sharding,
    simhash,
    token_files,
    toxicity,
)

#: Where the public vocabularies are, by file name; never copied.
vocabulary = public_tokenizers.path
TOKENIZERS = os.path.dirname(vocabulary("LICENSES.txt"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


#: Categories of the chain in their order, as conditions on the labels.
TOXICITY = {"junk": "quality = 0", "toxic": "toxic = 1"}


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities and rejection of every document."""
    docs = documents(spark, sf_dir)
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), TOXICITY)
    return toxicity.classify(docs, chain, list(TOXICITY))


def op2_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 greatest inner products of each query vector."""
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), is_query="vec_id % 20 = 0", k=20, scale=64.0)


def op3_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir), words=3, distance=2)


def op4_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    return grace_dedup.exact_groups(documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to files and read back."""
    files = token_files.write(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=1, vocabulary=49_408)
    return token_files.read_digest(files)


def op6_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.deal(documents(spark, sf_dir), shards=16)


def op7_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence."""
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=1024)


def op8_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.predict(docs, language.fit(docs))


def op9_winnowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted runs of lines and the remaining text of every document."""
    out = line_dedup.delete_repeats(documents(spark, sf_dir))
    runs = F.transform("deleted", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string")))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.array_join(runs, ",").alias("deleted"), "text")


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    return bpe_tree.round_trip_digest(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), PATTERN)


def op11_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    hits = decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    ids = F.sort_array(F.transform("items", lambda i: i.cast("string")))
    return hits.select(
        F.col("id").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        decontaminate.hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _crc32(value: Column) -> Column:
    return F.crc32(value.cast("string").cast("binary"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document by crc32 of its id repeats a stretch of its words to its end."""
    h = _crc32(F.col("doc_id"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeating(ws: Column) -> Column:
        n = F.size(ws)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        places = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
        # bound once: neither the words nor a and p are computed again for each word
        return F.transform(F.array(F.struct(ws.alias("ws"), a.alias("a"), p.alias("p"))), lambda b: F.array_join(
            F.transform(places, lambda i: F.get(b["ws"], F.when(i < b["a"], i).otherwise(b["a"] + F.pmod(i - b["a"], b["p"])).cast("int"))), " "
        ))[0]

    chosen = (F.pmod(h, F.lit(10)) == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    text = F.when(chosen, F.transform(F.array(words), repeating)[0]).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of periodic words of every document, the strongest, and the text without repeats."""
    found = periodic.detect(planted_runs(documents(spark, sf_dir))).withColumnRenamed("c0", "doc_id")
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate(
        "runs", none,
        lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b),
    )
    line = lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")])
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and roots of every document, and whether the text as found still verifies."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    docs = table(spark, sf_dir, "documents")
    changed = F.when(F.pmod(_crc32(F.col("f0")), F.lit(2)) == 0, F.translate("f4", "\n", "")).otherwise(F.col("f4"))
    proofs = manifest.manifest(docs, fields, "doc_id", "source", found={"text": changed})
    out = proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root",
        manifest.proof_digest(F.col("path")).alias("proof_sha256"),
        manifest.folded(F.col("found"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity_chain,
        op2_kdtree_topk,
        op3_simhash_links,
        op4_grace_dedup,
        op5_token_files,
        op6_hypergeometric_shards,
        op7_bin_slack_packing,
        op8_language_gru,
        op9_winnowed_lines,
        op10_bpe_tree,
        op11_prefix_decontamination,
        op12_periodic_runs,
        op13_merkle_manifest,
    )
}

#: crc32 of a decimal number in SQL: a table of 256 entries made by rule, then byte by byte.
_CRC32 = """
        crc_table AS (
            SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce([i::BIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                    lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                FROM range(256) r(i))
        ), crc AS (
            SELECT doc_id, xor(4294967295, list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')],
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
            FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table
        )"""

ORACLE_SQL = {
    "op11_prefix_decontamination": """
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS ws FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
        ), w AS (
            SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[k + 1 : k + 10], ' ') AS win
            FROM b, unnest(range(greatest(len(ws) - 9, 1))) u(k) WHERE len(ws) > 0
        ), s AS (
            SELECT r, size, k, array_to_string(ws[k + 1 : k + size], ' ') AS win
            FROM d, (SELECT DISTINCT size FROM w) z, unnest(range(len(ws) - size + 1)) u(k)
        ), o AS (
            SELECT r, k, s.size, item_id FROM s JOIN w ON s.win = w.win AND s.size = w.size
        ), hit AS (
            SELECT r, count(DISTINCT i) AS n FROM o, unnest(range(k, k + size)) u(i) GROUP BY r
        ), items AS (
            SELECT r, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
            FROM (SELECT DISTINCT r, item_id FROM o WHERE item_id IS NOT NULL) GROUP BY r
        )
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
    """,
    "op12_periodic_runs": f"""
        WITH {_CRC32}, split AS (
            SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents
        ), plan AS (
            SELECT split.doc_id, r, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, (h // 10) % greatest(len(ws), 1) AS a, (h // 10) % 8 AS e
            FROM split LEFT JOIN crc USING (doc_id)
        ), w AS (
            SELECT r, n, i, ws[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + e)) ELSE i END] AS word
            FROM plan, unnest(range(n)) u(i)
        ), pairs AS (
            SELECT a.r, b.i - a.i AS lag, a.i FROM w a JOIN w b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // 4
        ), stretches AS (
            SELECT r, lag, min(i) AS start, count(*) + lag AS length FROM (
                SELECT *, i - row_number() OVER (PARTITION BY r, lag ORDER BY i) AS island FROM pairs
            ) GROUP BY r, lag, island HAVING count(*) + lag >= greatest(6, 4 * lag)
        ), runs AS (
            SELECT r, start, length, min(lag) AS period FROM stretches GROUP BY r, start, length
        ), listed AS (
            SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
            FROM runs GROUP BY r
        ), best AS (
            SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) = 1
        ), gone AS (
            SELECT DISTINCT r, i FROM runs, unnest(range(start + period, start + length)) u(i)
        ), kept AS (
            SELECT r, string_agg(word, ' ' ORDER BY i) AS words FROM w ANTI JOIN gone USING (r, i) GROUP BY r
        )
        SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
               (length * 1000 // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
               sha256(coalesce(words, '')) AS collapsed_sha256
        FROM plan LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
    """,
    "op13_merkle_manifest": f"""
        WITH RECURSIVE {_CRC32}, fields AS (
            SELECT d.*, CASE WHEN h % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS seen FROM documents d LEFT JOIN crc USING (doc_id)
        ), hashed AS (
            SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) AS found
            FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM fields)
        ), leaves AS (
            SELECT *, coalesce('.' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS pos
            FROM hashed
        ), t AS (
            SELECT tree, 0 AS lvl, pos AS i, leaf AS hash, count(*) OVER (PARTITION BY tree) AS m FROM leaves
            UNION ALL
            SELECT tree, min(lvl) + 1, i // 3, sha256(string_agg(hash, '' ORDER BY i)), min((m + 2) // 3) FROM t WHERE m > 1 GROUP BY tree, i // 3
        ), subroots AS (
            SELECT tree, lvl AS height, hash AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE m = 1
        ), u AS (
            SELECT 0 AS lvl, pos AS i, subroot AS hash, n AS m FROM subroots
            UNION ALL
            SELECT min(lvl) + 1, i // 3, sha256(string_agg(hash, '' ORDER BY i)), min((m + 2) // 3) FROM u WHERE m > 1 GROUP BY i // 3
        ), nodes AS (  -- one tree over all: levels of the upper tree follow those of each source
            SELECT tree, lvl, i, hash, m FROM t
            UNION ALL
            SELECT s.tree, s.height + u.lvl, u.i, u.hash, u.m FROM u, subroots s WHERE u.m > 1
        ), kids AS (
            SELECT tree, lvl, i // 3 AS up, list(hash ORDER BY i) AS hs FROM nodes WHERE m > 1 GROUP BY tree, lvl, i // 3
        ), fold AS (
            SELECT doc_id, leaf, l.tree, 0 AS lvl, CASE WHEN height = 0 THEN s.pos ELSE l.pos END AS i, found AS node, '' AS sibs, height, s.pos AS s_pos
            FROM leaves l JOIN subroots s ON l.tree = s.tree
            UNION ALL
            SELECT doc_id, leaf, f.tree, f.lvl + 1, CASE WHEN f.lvl + 1 = height THEN s_pos ELSE i // 3 END,
                   sha256(array_to_string(hs[1 : i % 3], '') || node || array_to_string(hs[i % 3 + 2 : 3], '')),
                   sibs || array_to_string(hs[1 : i % 3], '') || array_to_string(hs[i % 3 + 2 : 3], ''), height, s_pos
            FROM fold f JOIN kids k ON f.tree = k.tree AND f.lvl = k.lvl AND f.i // 3 = k.up
        ), top AS (
            SELECT max(lvl) AS height, arg_max(hash, lvl) AS root FROM u
        )
        SELECT doc_id, leaf, subroot, root, sha256(sibs) AS proof_sha256, node AS folded_root, node = root AS verified
        FROM fold JOIN subroots s ON fold.tree = s.tree, top WHERE fold.lvl = s.height + top.height
    """,
    "op2_kdtree_topk": """
        WITH v AS (
            SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), p AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
        ), r AS (
            SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
                   vec_id, score
            FROM p
        )
        SELECT * FROM r WHERE rank <= 20
    """,
    "op4_grace_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_winnowed_lines": """
        WITH raw AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k
            FROM documents WHERE text <> ''
        ), l AS (
            SELECT doc_id, k, trim(line) AS line, len(regexp_extract_all(line, '\\S+')) AS w FROM raw WHERE trim(line) <> ''
        ), n AS (
            SELECT *, lead(k, 1) OVER o AS k1, lead(k, 2) OVER o AS k2, lead(line, 1) OVER o AS line1,
                   lead(line, 2) OVER o AS line2, lead(w, 1) OVER o AS w1
            FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY k)
        ), s AS (
            SELECT doc_id, k AS first,
                   CASE WHEN w >= 50 THEN k WHEN w + w1 >= 50 THEN k1 ELSE k2 END AS last,
                   CASE WHEN w >= 50 THEN line WHEN w + w1 >= 50 THEN line || chr(10) || line1
                        ELSE line || chr(10) || line1 || chr(10) || line2 END AS content
            FROM n
        ), later AS (
            SELECT * FROM (
                SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS turn FROM s WHERE last IS NOT NULL
            ) WHERE turn > 1
        ), gone AS (
            SELECT DISTINCT raw.doc_id, raw.k FROM raw JOIN later ON raw.doc_id = later.doc_id AND raw.k BETWEEN first AND last
        ), runs AS (
            SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS deleted FROM (
                SELECT doc_id, min(k) AS a, max(k) AS b FROM (
                    SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM gone
                ) GROUP BY doc_id, island
            ) GROUP BY doc_id
        ), kept AS (
            SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS remaining
            FROM raw ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
        )
        SELECT d.doc_id, CASE WHEN text <> '' THEN len(string_split(text, chr(10))) ELSE 0 END AS n_lines,
               coalesce(deleted, '') AS deleted,
               CASE WHEN deleted IS NULL THEN text ELSE coalesce(remaining, '') END AS text
        FROM documents d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
}
