"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, kmeans, language_id, line_dedup, lm, matroska, mixing, near_dup, pii, quality, token_files, wavelet_search
from .common import documents, spread


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_token_files(documents(spark, sf_dir)).digests()


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.stored_media_digests(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_languages(documents(spark, sf_dir))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), near_dup.Settings(words=3, of=85))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.with_quality(documents(spark, sf_dir)).select(*names)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_chats(chat.chat_records(rows.unionByName(extra))))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(documents(spark, sf_dir))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return wavelet_search.search(wavelet_search.build_index(documents(spark, sf_dir)), items, k=10)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster_digests(spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(documents(spark, sf_dir), min_docs=10, min_chars=1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_matroska": op2_matroska,
        "op3_bpe": op3_bpe,
        "op4_language_id": op4_language_id,
        "op5_near_dup": op5_near_dup,
        "op6_pii": op6_pii,
        "op7_mixing": op7_mixing,
        "op8_quality": op8_quality,
        "op9_chat": op9_chat,
        "op10_lm": op10_lm,
        "op11_search": op11_search,
        "op12_clusters": op12_clusters,
        "op13_line_dedup": op13_line_dedup,
    }


_SPACE = "[ \\t\\n\\x0b\\f\\r]+"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _without(text: str, characters: str) -> str:
    return f"translate({text}, {characters}, '')"


def op8_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    rules = {
        "n_words": "n_words", "mean_word_length": "CASE WHEN n_words > 0 THEN word_chars / CAST(n_words AS DOUBLE) ELSE 0 END",
        "symbol_ratio": "CASE WHEN word_chars > 0 THEN n_symbols / CAST(word_chars AS DOUBLE) ELSE 0 END", "stop_word_ratio": "CASE WHEN n_words > 0 THEN n_stop / CAST(n_words AS DOUBLE) ELSE 0 END",
        "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines / CAST(n_lines AS DOUBLE) ELSE 0 END", "repeat_word_ratio": "CASE WHEN n_words > 0 THEN n_repeat_words / CAST(n_words AS DOUBLE) ELSE 0 END",
    }
    passed = " AND ".join(f"({rules[r.feature]}) BETWEEN {r.low} AND {r.high}" for r in quality.RULES)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: {_without("x", _SPACES)} <> '') AS l FROM d),
        g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w) x),
        c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
        p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY doc_id),
        f AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, length({_without("t", _SPACES)}) AS word_chars, length(t) - length({_without("t", "'" + quality.SYMBOLS + "'")}) AS n_symbols,
            CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop,
            coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN p ON w.doc_id = p.doc_id),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {passed} AS kept FROM b"""


def op7_sql() -> str:
    weights = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(mixing.WEIGHTS))
    return f"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        s AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda x: x <> '')) AS BIGINT) AS size,
            length({_without("t", _SPACES)}) AS solid, length(t) - length({_without("t", "'" + quality.SYMBOLS + "'")}) AS symbols,
            (CAST(CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / {float(2**48)} AS u FROM d),
        k AS (SELECT doc_id, source, size, -ln(u) / greatest(0.5, 2.0 - 15.0 * CASE WHEN solid > 0 THEN symbols / CAST(solid AS DOUBLE) ELSE 1.0 END) AS key FROM s),
        g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
        w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {weights} END AS weight, CAST({mixing.MAX_EPOCHS} * source_size AS DOUBLE) AS cap FROM g),
        l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS pos FROM w),
        f AS (SELECT arg_min(level, pos) AS level FROM l WHERE level * weight <= cap),
        t AS (SELECT l.source, source_size, CAST(least(cap, coalesce(f.level, 0.0) * weight) AS DOUBLE) AS target FROM l, f),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
        r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
            coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, CAST(k.doc_id AS VARCHAR), k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN before < rest AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""


_LOWER_CASE = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op11_sql(k: int = 10) -> str:
    found = f"regexp_extract_all({_LOWER_CASE.format("coalesce(text, '')")}, '{wavelet_search.TERM}')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {found} AS t FROM documents),
        n AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
        g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
        m AS (SELECT r, doc_id, 100 - 75 + (75 * n * docs) // total AS m FROM n, g),
        q AS (SELECT b, item_id, term, count(*) AS c FROM (SELECT row_number() OVER () AS b, item_id, unnest({found}) AS term FROM benchmark) x GROUP BY ALL),
        p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) x WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, g GROUP BY term, docs),
        s AS (SELECT b, item_id, m.r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) x WHERE rank <= {k}"""


def op12_sql(k: int = kmeans.CLUSTERS, rounds: int = kmeans.ROUNDS, width: int = kmeans.DIMENSIONS) -> str:
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({kmeans.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT c, x FROM (SELECT row_number() OVER (ORDER BY sha256('{kmeans.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), x) - 1 AS c, x FROM v) y WHERE c < {k})",
    ]
    apart = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': d, 'c': c}}) AS best FROM (SELECT r, vec_id, v.x, c, {apart} AS d FROM v, c{i} c) y GROUP BY r)")
        if i < rounds:
            parts.append(f"""u{i} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM
                (SELECT best.c AS c, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {width + 1})) AS j) t GROUP BY ALL) y GROUP BY c)""")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(u{i}.x, c.x) AS x FROM c{i} c LEFT JOIN u{i} ON c.c = u{i}.c)")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.best.c = c.c"""


def op13_sql(min_docs: int = line_dedup.MIN_DOCS, min_chars: int = line_dedup.MIN_CHARS) -> str:
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        l AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
        k AS (SELECT *, {_LOWER_CASE.format(f"trim(line, {_SPACES})")} AS key FROM l),
        s AS (SELECT key FROM k WHERE length(key) >= {min_chars} AND key <> '' GROUP BY key HAVING count(DISTINCT r) >= {min_docs})
        SELECT doc_id, count(*) AS n_lines, count(s.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN s ON k.key = s.key GROUP BY r, doc_id"""


def oracle_sql() -> dict[str, str]:
    """op7, op8 and op11 to op13; the others need a tokenizer, a codec, a trained model or repeated links, and are tested against brute force."""
    return {"op7_mixing": op7_sql(), "op8_quality": op8_sql(), "op11_search": op11_sql(), "op12_clusters": op12_sql(), "op13_line_dedup": op13_sql()}
