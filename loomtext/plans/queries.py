"""The registry of queries over the derived relations, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import benchmarks, curate, metrics, vocabulary
from loomtext.plans.fixtures import PAIRS_SQL, PREDICTIONS_SQL, RATINGS_SQL, pairs, predictions, ratings, sheet, table, texts
from loomtext.plans.runtime import fresh_path, materialise
from loomtext.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# The text rules in RE2, which has no look-around: what stands at an edge is captured and put back, twice.
_WS, _W = r"[\s\pZ\x0B\x1C-\x1F\x{85}]", r"\p{L}\p{N}_"


def _sub(x: str, pattern: str, put: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{put.replace(chr(39), chr(39) * 2)}', '{flags}')"


def _strip(x: str) -> str:
    return _sub(x, f"^{_WS}+|{_WS}+$", "")


def _collapse(x: str) -> str:
    return _strip(_sub(x, f"{_WS}+", " "))


def _detok(x: str) -> str:
    x = _sub(_collapse(x), rf"{_WS}+([,.;:!?%])", r"\1")
    x = _sub(_sub(x, rf"([({{\[]){_WS}+", r"\1"), rf"{_WS}+([)}}\]])", r"\1")
    for _ in range(2):
        x = _sub(x, rf"(^|[^{_W}])([A-Za-z]+){_WS}+'{_WS}*(s|t|re|ve|ll|d|m)($|[^{_W}])", r"\1\2'\3\4", "gi")
    for _ in range(2):
        x = _sub(x, rf"([{_W}]){_WS}+-{_WS}+([{_W}])", r"\1-\2")
    return _collapse(x)


def _cited(x: str) -> str:
    return _strip(_sub(x, rf"^{_WS}*(\([^)]{{0,100}}\d+{_WS}*:{_WS}*\d+[^)]*\){_WS}*)+", ""))


def _key(x: str) -> str:
    return _collapse(_sub(f"replace(lower({_detok(x)}), 'ß', 'ss')", rf"[^{_W}\s\pZ\x0B\x1C-\x1F\x{{85}}'-]", " "))


def _words(x: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda t: t <> '')) AS INT)"


_MARK = rf"(^|[^{_W}])(jehovah|bible|jesus|christ|christian|god|apostle|congregation|ministry|scripture|kingdom|worship|baptis[{_W}]*|disciple|preach[{_W}]*|prayer|resurrection|satan)($|[^{_W}])"


def _marked(x: str) -> str:
    return f"regexp_matches({x}, '{_MARK}', 'i')"


_AUDIT = f"""WITH {PAIRS_SQL},
k AS MATERIALIZED (SELECT *, {_key("eng")} AS eng_norm, {_key("wes")} AS wes_norm, greatest({_words("eng")}, 1) AS ew, greatest({_words("wes")}, 1) AS ww FROM pairs),
a AS MATERIALIZED (SELECT *, CAST(ww AS DOUBLE) / ew AS ratio FROM k)"""
_ID = "substr(sha256(eng_norm || chr(0) || wes_norm), 1, 16)"
_JUDGED = f"""WITH {PAIRS_SQL},
c AS MATERIALIZED (SELECT source_index, eng AS eng_raw, wes AS wes_raw, {_cited(_detok("eng"))} AS eng, {_cited(_detok("wes"))} AS wes FROM pairs),
k AS MATERIALIZED (SELECT *, {_key("eng")} AS eng_norm, {_key("wes")} AS wes_norm, {_words("eng")} AS eng_words, {_words("wes")} AS wes_words FROM c),
f AS (SELECT *, CAST(wes_words AS DOUBLE) / greatest(eng_words, 1) AS ratio FROM k),
j AS (SELECT *, round(ratio, 6) AS word_ratio, list_filter([CASE WHEN eng = '' OR wes = '' THEN 'empty' END, CASE WHEN ratio > 3.0 THEN 'ratio_too_high' END,
   CASE WHEN ratio < 0.35 THEN 'ratio_too_low' END, CASE WHEN greatest(eng_words, wes_words) > 180 THEN 'too_long' END,
   CASE WHEN least(eng_words, wes_words) < 2 THEN 'too_short' END], lambda x: x IS NOT NULL) AS reasons FROM f),
n AS (SELECT *, CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, ',') END AS broken,
   row_number() OVER (PARTITION BY eng_norm, wes_norm, len(reasons) > 0 ORDER BY source_index) AS copy FROM j),
r AS MATERIALIZED (SELECT *, CASE WHEN broken IS NULL AND copy > 1 THEN 'normalized_duplicate' ELSE broken END AS rejection_reason FROM n),
clean AS MATERIALIZED (SELECT source_index, eng_raw, wes_raw, eng, wes, eng_norm, wes_norm, eng_words, wes_words, word_ratio, {_ID} AS example_id, {_marked("eng")} AS religious_domain_marker FROM r WHERE rejection_reason IS NULL)"""
_ROUNDS = 16
_LABELS = ",\n".join(
    f"l{i} AS MATERIALIZED (SELECT source_index, eng_norm, wes_norm, example_id, least(min({c}) OVER (PARTITION BY eng_norm), min({c}) OVER (PARTITION BY wes_norm)) AS c FROM {t})"
    for i, (t, c) in enumerate([("clean", "source_index")] + [(f"l{k}", "c") for k in range(_ROUNDS)])
)
_SPLIT = f"""{_JUDGED}, {_LABELS},
g AS (SELECT c, CAST(('0x' || substr(sha256('42:' || string_agg(example_id, '|' ORDER BY example_id)), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551615.0::DOUBLE AS score FROM l{_ROUNDS} GROUP BY c),
split AS MATERIALIZED (SELECT l.source_index, l.eng_norm, l.wes_norm, l.example_id, substr(sha256('42:' || l.c), 1, 12) AS group_id,
   CASE WHEN score < 0.05::DOUBLE THEN 'test' WHEN score < 0.05::DOUBLE + 0.05::DOUBLE THEN 'validation' ELSE 'train' END AS split FROM l{_ROUNDS} l JOIN g USING (c))"""


@query("detokenize", f"WITH {PAIRS_SQL} SELECT source_index, {_detok('eng')} AS eng, {_detok('wes')} AS wes FROM pairs")
def _(spark, d):
    return pairs(spark, d).select("source_index", T.detokenize("eng").alias("eng"), T.detokenize("wes").alias("wes"))


@query("strip_citation", f"WITH {PAIRS_SQL} SELECT source_index, {_cited('wes')} AS wes FROM pairs")
def _(spark, d):
    return pairs(spark, d).select("source_index", T.strip_citations("wes").alias("wes"))


@query("normalize_key", f"WITH {PAIRS_SQL} SELECT source_index, {_key('eng')} AS eng_norm, {_key('wes')} AS wes_norm FROM pairs")
def _(spark, d):
    return curate.with_keys(pairs(spark, d)).select("source_index", "eng_norm", "wes_norm")


@query("example_id", f"{_AUDIT} SELECT source_index, {_ID} AS example_id FROM a")
def _(spark, d):
    return curate.with_keys(pairs(spark, d)).select("source_index", T.example_id("eng_norm", "wes_norm").alias("example_id"))


@query("word_stats", f"{_AUDIT} SELECT source_index, {_words('eng')} AS eng_words, {_words('wes')} AS wes_words, ew AS eng_clipped, ww AS wes_clipped, round(ratio, 6) AS ratio FROM a")
def _(spark, d):
    rows = pairs(spark, d).withColumns({"eng_words": T.word_count("eng"), "wes_words": T.word_count("wes")})
    rows = rows.withColumns({"eng_clipped": F.greatest("eng_words", F.lit(1)), "wes_clipped": F.greatest("wes_words", F.lit(1))})
    return rows.select("source_index", "eng_words", "wes_words", "eng_clipped", "wes_clipped", F.round(F.col("wes_clipped") / F.col("eng_clipped"), 6).alias("ratio"))


@query("text_flags", rf"WITH {PAIRS_SQL} SELECT source_index, {_marked('eng')} AS marker, regexp_matches(eng, '{_WS}[,.;:!?]') AS spaced, regexp_matches(wes, '^{_WS}*\(') AS parenthesis FROM pairs")
def _(spark, d):
    return pairs(spark, d).select("source_index", T.domain_marker("eng").alias("marker"), T.spaced_punctuation("eng").alias("spaced"), T.leading_parenthesis("wes").alias("parenthesis"))


@query("audit_counts", rf"""{_AUDIT} SELECT count(*) AS rows, count_if(eng IS NULL) AS null_eng, count_if(wes IS NULL) AS null_wes, count_if({_strip("eng")} = '') AS blank_eng, count_if({_strip("wes")} = '') AS blank_wes,
  count(*) - count(DISTINCT (eng, wes)) AS exact_duplicate_pairs, count(*) - count(DISTINCT (eng_norm, wes_norm)) AS normalized_duplicate_pairs, count(*) - count(DISTINCT eng_norm) AS duplicate_english_rows,
  count(*) - count(DISTINCT wes_norm) AS duplicate_wes_rows, count_if(ratio < 0.4::DOUBLE) AS word_ratio_below_0_4, count_if(ratio > 2.5::DOUBLE) AS word_ratio_above_2_5, count_if({_marked("eng")}) AS religious_marker_rows,
  count_if(regexp_matches(eng, '{_WS}[,.;:!?]')) AS english_space_before_punctuation_rows,
  count_if(NOT regexp_matches(eng, '^{_WS}*\(') AND regexp_matches(wes, '^{_WS}*\(')) AS target_only_leading_parenthetical_rows FROM a""")
def _(spark, d):
    return curate.audit_counts(pairs(spark, d))


def _summary_sql(name: str, c: str) -> str:
    return f"SELECT '{name}' AS measure, round(avg({c}), 6) AS mean, " + ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {q}), 6) AS {k}" for q, k in ((0.01, "p01"), (0.5, "p50"), (0.95, "p95"), (0.99, "p99"))) + f", round(max(CAST({c} AS DOUBLE)), 6) AS max FROM a"


@query("audit_summary", f"{_AUDIT} " + " UNION ALL ".join(_summary_sql(n, c) for n, c in (("english_word_counts", "ew"), ("wes_word_counts", "ww"), ("wes_to_english_word_ratio", "ratio"))))
def _(spark, d):
    return curate.audit_summary(pairs(spark, d)).select("measure", *(F.round(c, 6).alias(c) for c in ("mean", "p01", "p50", "p95", "p99", "max")))


@query("conflict_groups", f"""{_AUDIT}, e AS (SELECT count(DISTINCT wes_norm) AS n FROM a GROUP BY eng_norm), w AS (SELECT count(DISTINCT eng_norm) AS n FROM a GROUP BY wes_norm)
  SELECT 'eng' AS side, count_if(n > 1) AS groups FROM e UNION ALL SELECT 'wes', count_if(n > 1) FROM w""")
def _(spark, d):
    return curate.conflict_groups(pairs(spark, d))


@query("fingerprint", f"{_AUDIT} SELECT sha256(string_agg(p, chr(10) ORDER BY p)) AS fingerprint_sha256 FROM (SELECT eng_norm || chr(0) || wes_norm AS p FROM a)")
def _(spark, d):
    return curate.fingerprint(pairs(spark, d).select("eng", "wes"))


@query("corpus_digest")
def _(spark, d):
    return curate.corpus_digest(pairs(spark, d))


@query("clean_pairs", f"{_JUDGED} SELECT * FROM clean")
def _(spark, d):
    return curate.clean_pairs(pairs(spark, d))


@query("rejected_pairs", f"{_JUDGED} SELECT source_index, eng_raw, wes_raw, eng, wes, eng_norm, wes_norm, eng_words, wes_words, word_ratio, rejection_reason FROM r WHERE rejection_reason IS NOT NULL")
def _(spark, d):
    return curate.rejected_pairs(pairs(spark, d))


@query("rejection_counts", f"{_JUDGED} SELECT rejection_reason, count(*) AS rows FROM r WHERE rejection_reason IS NOT NULL GROUP BY 1 ORDER BY 1")
def rejection_counts(spark, d):
    return curate.rejection_counts(pairs(spark, d))


@query("reason_counts", f"{_JUDGED} SELECT reason, count(*) AS rows FROM (SELECT unnest(reasons) AS reason FROM j) GROUP BY 1")
def _(spark, d):
    return curate.reason_counts(pairs(spark, d))


@query("dedup_first", f"{_JUDGED} SELECT source_index, eng, wes FROM clean")
def _(spark, d):
    return curate.valid_pairs(pairs(spark, d))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return curate.split_pairs(materialise(curate.clean_pairs(pairs(spark, d)), "clean"))


@query("components", f"{_JUDGED}, {_LABELS} SELECT source_index, c AS component FROM l{_ROUNDS}")
def _(spark, d):
    return curate.pair_components(materialise(curate.clean_pairs(pairs(spark, d)), "clean")).select("source_index", "component")


@query("split_assign", f"{_SPLIT} SELECT source_index, example_id, group_id, split FROM split")
def _(spark, d):
    return _split(spark, d).select("source_index", "example_id", "group_id", "split")


@query("split_manifest", f"{_SPLIT} SELECT split, count(*) AS rows, count(DISTINCT group_id) AS groups FROM split GROUP BY split")
def _(spark, d):
    return curate.split_manifest(_split(spark, d))


@query("split_leak_check", f"""{_SPLIT}, e AS (SELECT 'eng_norm' AS side, eng_norm AS key, count(DISTINCT split) AS splits FROM split GROUP BY 2), w AS (SELECT 'wes_norm' AS side, wes_norm AS key, count(DISTINCT split) AS splits FROM split GROUP BY 2)
  SELECT * FROM e WHERE splits > 1 UNION ALL SELECT * FROM w WHERE splits > 1""")
def _(spark, d):
    return curate.split_leaks(_split(spark, d))


@query("publish_split", f"{_SPLIT} SELECT s.example_id AS id, c.eng, c.wes, {{'eng': c.eng, 'wes': c.wes}}.eng || chr(9) || c.wes AS joined, s.split FROM split s JOIN clean c USING (source_index)")
def _(spark, d):
    rows = curate.public_split(_split(spark, d))
    return rows.select("id", "eng", "wes", F.concat("translation.eng", F.char(F.lit(9)), "translation.wes").alias("joined"), "split")


@query("quick_subset", f"""{_SPLIT} (SELECT source_index, split FROM split WHERE split = 'train' ORDER BY md5('42:' || example_id), example_id LIMIT 2000)
  UNION ALL (SELECT source_index, split FROM split WHERE split = 'validation' ORDER BY source_index LIMIT 300)
  UNION ALL (SELECT source_index, split FROM split WHERE split = 'test' ORDER BY source_index LIMIT 300)""")
def _(spark, d):
    return curate.quick_subset(_split(spark, d)).select("source_index", "split")


@query("seeded_shuffle", f"{_SPLIT} SELECT source_index, row_number() OVER (ORDER BY sha256('42:' || example_id), example_id) AS place FROM split WHERE split = 'train'")
def _(spark, d):
    return curate.shuffled_places(_split(spark, d).where("split = 'train'")).select("source_index", "place")


@query("read_split", f"{_SPLIT} SELECT s.example_id AS id, c.eng, c.wes, s.split FROM split s JOIN clean c USING (source_index) WHERE s.split = 'validation'")
def _(spark, d):
    path = fresh_path(spark, "public-split")
    io.write_public_split(_split(spark, d), path)
    return io.read_split(spark, path, "validation").select("id", "eng", "wes", "split")


@query("split_leaks_found", f"""{_JUDGED}, careless AS (SELECT eng_norm, wes_norm, source_index % 3 AS part FROM clean),
  e AS (SELECT 'eng_norm' AS side, eng_norm AS key, count(DISTINCT part) AS splits FROM careless GROUP BY 2), w AS (SELECT 'wes_norm' AS side, wes_norm AS key, count(DISTINCT part) AS splits FROM careless GROUP BY 2)
  SELECT * FROM e WHERE splits > 1 UNION ALL SELECT * FROM w WHERE splits > 1""")
def _(spark, d):
    careless = curate.clean_pairs(pairs(spark, d)).withColumn("split", (F.col("source_index") % 3).cast("string"))
    return curate.split_leaks(materialise(careless.select("eng_norm", "wes_norm", "split"), "careless-split"))


@query("csv_round_trip", f"WITH {PAIRS_SQL} SELECT source_index, eng, wes FROM pairs")
def _(spark, d):
    path = fresh_path(spark, "csv")
    io.write_csv(pairs(spark, d).select("source_index", "eng", "wes"), path)
    return io.read_csv(spark, path, "source_index long, eng string, wes string")


@query("parquet_pairs", f"WITH {PAIRS_SQL} SELECT source_index, eng, wes FROM pairs")
def _(spark, d):
    path = fresh_path(spark, "pairs")
    pairs(spark, d).write.parquet(path)
    return io.read_pairs(spark, path, "source_index")


@query("tokenized_union", f"""WITH {PAIRS_SQL}, w AS (SELECT source_index, 'en-wes' AS direction, '>>wes<< ' || eng AS s, wes AS t FROM pairs UNION ALL SELECT source_index, 'wes-en', '>>eng<< ' || wes, eng FROM pairs)
  SELECT source_index, direction, array_to_string(list_transform(list_filter(string_split(s, ''), lambda c: c <> '')[1:24], lambda c: unicode(c)), ' ') AS input_ids,
    array_to_string(list_transform(list_filter(string_split(t, ''), lambda c: c <> '')[1:24], lambda c: unicode(c)), ' ') AS labels FROM w""")
def _(spark, d):
    rows = vocabulary.tokenized(pairs(spark, d), "marian", ["en-wes", "wes-en"], lambda texts: [[ord(c) for c in t] for t in texts], 24, ["source_index"])
    return rows.select("source_index", "direction", *(F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("input_ids", "labels")))


@query("format_direction", f"""WITH {PAIRS_SQL} SELECT source_index, '>>wes<< ' || eng AS marian, 'translate Cameroon Pidgin to English: ' || wes AS byt5, eng AS nllb FROM pairs""")
def _(spark, d):
    f = vocabulary.formatted
    return pairs(spark, d).select("source_index", f(F.col("eng"), "marian", "en-wes").alias("marian"), f(F.col("wes"), "byt5", "wes-en").alias("byt5"), f(F.col("eng"), "nllb", "en-wes").alias("nllb"))


_SHEET = """WITH sheet AS (SELECT 'b-' || item_id AS id, text AS source, 'ref ' || text AS reference, 'news' AS domain, CASE WHEN item_id % 9 = 0 THEN '  ' ELSE 't1' END AS translator_id, 'r1' AS reviewer_id,
  CASE WHEN item_id % 4 = 0 THEN 'Approved' WHEN item_id % 4 = 1 THEN 'approved' ELSE 'pending' END AS adjudication_status FROM benchmark)"""


@query("bidirectional_rows", f"""{_SHEET} SELECT id || '-en-wes' AS id, 'en-wes' AS direction, source, reference, domain, translator_id, reviewer_id, adjudication_status FROM sheet
  UNION ALL SELECT id || '-wes-en', 'wes-en', reference, source, domain, translator_id, reviewer_id, adjudication_status FROM sheet""")
def _(spark, d):
    return benchmarks.both_directions(sheet(spark, d))


@query("direction_counts", "SELECT unnest(['en-wes', 'wes-en']) AS direction, count(*) AS rows FROM benchmark")
def _(spark, d):
    return benchmarks.direction_counts(benchmarks.both_directions(sheet(spark, d)))


@query("release_gate", f"""{_SHEET} SELECT count(*) AS rows, count_if(trim(source) = '') AS blank_sources, count_if(trim(reference) = '') AS blank_references, count_if(lower(adjudication_status) <> 'approved') AS not_approved,
  count_if(trim(translator_id) = '' OR trim(reviewer_id) = '') AS without_people, count(*) - count(DISTINCT id) AS repeated_ids FROM sheet""")
def _(spark, d):
    return benchmarks.release_faults(sheet(spark, d))


@query("worksheet", """SELECT printf('bench-v1-%04d', row_number() OVER (ORDER BY item_id)) AS id, 'en-wes' AS direction, text AS source, '' AS reference, '' AS reference_2, '' AS domain, 'own:en:all' AS source_origin,
  '' AS translator_id, '' AS reviewer_id, '' AS adjudication_status, '' AS notes FROM benchmark""")
def _(spark, d):
    return benchmarks.worksheet(table(spark, d, "benchmark"), "item_id", "own:en:all")


@query("worksheet_head", "SELECT printf('bench-v1-%04d', row_number() OVER (ORDER BY item_id)) AS id, text AS source FROM benchmark ORDER BY item_id LIMIT 10")
def _(spark, d):
    return benchmarks.worksheet(table(spark, d, "benchmark"), "item_id", "own:en:all", limit=10).select("id", "source")


@query("one_to_one_join", f"WITH {PREDICTIONS_SQL} SELECT id, direction, reference, a AS prediction_a, b AS prediction_b FROM preds")
def _(spark, d):
    return metrics.aligned_systems(predictions(spark, d, "a"), predictions(spark, d, "b"))


@query("completed_rows", f"WITH {PREDICTIONS_SQL} SELECT id, direction, source, reference FROM preds")
def _(spark, d):
    return benchmarks.completed_rows(predictions(spark, d).drop("prediction").withColumnRenamed("reference", "reference_1"))


@query("char_frequency", rf"WITH c AS (SELECT unnest(string_split(text, '')) AS character FROM documents) SELECT character, count(*) AS n FROM c WHERE character <> '' AND NOT regexp_matches(character, '^{_WS}$') GROUP BY 1 HAVING count(*) >= 5")
def _(spark, d):
    return vocabulary.character_counts(table(spark, d, "documents"), "text", 5)


_VOCABULARY = """WITH b AS (SELECT p_brand AS piece, max(-CAST(p_size AS DOUBLE)) AS score, 1 AS type FROM part GROUP BY 1),
t AS (SELECT p_type AS piece, -CAST(p_size AS DOUBLE) / 2 AS score, CASE WHEN p_size % 5 = 0 THEN 2 ELSE 1 END AS type FROM part UNION ALL SELECT p_brand, -0.5, 1 FROM part)"""


@query("vocab_merge", f"""{_VOCABULARY} SELECT piece, score, CAST(type AS INT) AS type, false AS added FROM b
  UNION ALL SELECT piece, (SELECT min(score) FROM b) + max(score), 1, true FROM t WHERE type = 1 AND piece NOT IN (SELECT piece FROM b) GROUP BY piece""")
def _(spark, d):
    part = table(spark, d, "part")
    size = F.col("p_size").cast("double")
    base = part.groupBy(F.col("p_brand").alias("piece")).agg(F.max(-size).alias("score")).withColumn("type", F.lit(1))
    trained = part.select(F.col("p_type").alias("piece"), (-size / 2).alias("score"), F.when(F.col("p_size") % 5 == 0, 2).otherwise(1).alias("type"))
    return vocabulary.merged_vocabulary(base, trained.unionByName(part.select(F.col("p_brand").alias("piece"), F.lit(-0.5).alias("score"), F.lit(1).alias("type"))))


@query("remap_join", "SELECT a.p_name || a.p_partkey AS token, a.p_partkey AS old_id, a.p_partkey + 7 AS new_id FROM part a WHERE a.p_partkey <> 3 AND a.p_partkey + 7 <> 12 AND a.p_size > 10")
def _(spark, d):
    rows = table(spark, d, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("token"), F.col("p_partkey").alias("id"), "p_size")
    return vocabulary.remapped_ids(rows, rows.where("p_size > 10").withColumn("id", F.col("id") + 7), 3, 12)


_CELLS = "WITH x AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS x FROM embeddings)"


@query("vector_mean", f"{_CELLS} SELECT label, CAST(pos - 1 AS INT) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM x GROUP BY 1, 2")
def _(spark, d):
    rows = vocabulary.mean_vectors(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return rows.select("label", F.posexplode("vector").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


@query("warm_start", """WITH t AS (SELECT vec_id AS token, CASE WHEN vec_id % 3 = 0 THEN [vec_id, vec_id + 1, -1] WHEN vec_id % 3 = 1 THEN [-5::BIGINT] ELSE [vec_id] END AS ids FROM embeddings),
  p AS (SELECT token, unnest(ids) AS id FROM t), k AS (SELECT p.token, p.id FROM p JOIN embeddings e ON e.vec_id = p.id),
  a AS (SELECT * FROM k UNION ALL SELECT DISTINCT token, 0 FROM t WHERE token NOT IN (SELECT token FROM k)),
  x AS (SELECT a.token, unnest(range(1, len(e.embedding) + 1)) AS pos, unnest(e.embedding) AS x FROM a JOIN embeddings e ON e.vec_id = a.id)
  SELECT token, CAST(pos - 1 AS INT) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM x GROUP BY 1, 2""")
def _(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    ids = F.expr("case when id % 3 = 0 then array(id, id + 1, -1L) when id % 3 = 1 then array(-5L) else array(id) end")
    rows = vocabulary.warm_started(vectors, vectors.select(F.col("id").alias("token"), ids.alias("ids")), 0)
    return rows.select("token", F.posexplode("vector").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


@query("shift_right", "WITH l AS (SELECT o_orderkey, list(CASE WHEN l_linenumber = 2 THEN -100 ELSE l_linenumber END ORDER BY l_linenumber, l_partkey) AS ids FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) SELECT o_orderkey, array_to_string(list_prepend(2, list_transform(ids[1:len(ids) - 1], lambda x: CASE WHEN x = -100 THEN 1 ELSE x END)), ' ') AS ids FROM l")
def _(spark, d):
    rows = _order_ids(spark, d, "case when l_linenumber = 2 then -100 else l_linenumber end")
    return rows.select("o_orderkey", F.array_join(vocabulary.shifted_right(F.col("ids"), 2, 1).cast("array<string>"), " ").alias("ids"))


def _order_ids(spark: SparkSession, d: str, item: str) -> DataFrame:
    """The line numbers of each order as a token list; an order has a few lines."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.expr(item).alias("x")))).alias("s")).select("o_orderkey", F.col("s.x").alias("ids"))


@query("pad_multiple", "WITH l AS (SELECT l_orderkey AS o_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) SELECT o_orderkey, array_to_string(list_concat(ids[1:5], list_transform(range((8 - len(ids[1:5]) % 8) % 8), lambda x: 0)), ' ') AS ids FROM l")
def _(spark, d):
    rows = _order_ids(spark, d, "l_linenumber").withColumn("ids", vocabulary.truncated(F.col("ids"), 5))
    return rows.select("o_orderkey", F.array_join(vocabulary.padded(F.col("ids"), 0).cast("array<string>"), " ").alias("ids"))


_RATES = f"""WITH {PREDICTIONS_SQL}, s AS (SELECT id, direction, {_key("a")} = {_key("reference")} AS exact_match, {_key("a")} = {_key("source")} AS source_copy,
  CAST(greatest({_words("a")}, 1) AS DOUBLE) / greatest({_words("reference")}, 1) AS length_ratio FROM preds)"""


@query("exact_match", f"{_RATES} SELECT id, exact_match FROM s")
def _(spark, d):
    return metrics.score_rows(predictions(spark, d)).select("id", "exact_match")


@query("copy_rate", f"{_RATES} SELECT direction, round(avg(CAST(source_copy AS INT) * 100.0), 6) AS source_copy_percent FROM s GROUP BY 1")
def _(spark, d):
    rows = metrics.score_rows(predictions(spark, d))
    return rows.groupBy("direction").agg(F.round(F.avg(F.col("source_copy").cast("double") * 100), 6).alias("source_copy_percent"))


@query("length_ratio", f"{_RATES} SELECT direction, round(avg(length_ratio), 6) AS mean_ratio FROM s GROUP BY 1")
def _(spark, d):
    return metrics.score_rows(predictions(spark, d)).groupBy("direction").agg(F.round(F.avg("length_ratio"), 6).alias("mean_ratio"))


# Tokens and n-gram counts of both systems (x) and the reference, for BLEU and chrF++ in SQL.
def _tokens(x: str) -> str:
    x = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{entity}', '{char}')"
    x = _sub(f"' ' || {x} || ' '", r"([\{-\~\[-\x60 -\&\(-\+\:-\@\/])", r" \1 ")
    x = _sub(_sub(x, r"([^0-9])([\.,])", r"\1 \2 "), r"([\.,])([^0-9])", r" \1 \2")
    return f"list_filter(string_split({_sub(x, '([0-9])(-)', chr(92) + '1 ' + chr(92) + '2 ')}, ' '), lambda t: t <> '')"


_EDGE = r"""list_transform(list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> ''), lambda t: CASE WHEN length(t) > 1 AND regexp_matches(t[-1:], '[!-/:-@\[-\x60{{-~]') THEN [t[:length(t) - 1], t[-1:]]
  WHEN length(t) > 1 AND regexp_matches(t[1:1], '[!-/:-@\[-\x60{{-~]') THEN [t[1:1], t[2:]] ELSE [t] END)"""
_GRAMS = """grams AS MATERIALIZED (SELECT side, kind, id, direction, n, array_to_string(t[i:i + n - 1], chr(1)) AS g, count(*) AS c
  FROM (SELECT *, unnest(range(1, CAST(len(t) - n + 2 AS BIGINT))) AS i FROM (SELECT *, unnest(range(1, top + 1)) AS n FROM toks)) GROUP BY ALL),
m AS (SELECT h.side, h.kind, h.id, h.direction, h.n, sum(least(h.c, r.c)) AS hit FROM grams h JOIN grams r ON h.kind = r.kind AND h.id = r.id AND h.direction = r.direction AND h.n = r.n AND h.g = r.g AND r.side = 'r' AND h.side <> 'r' GROUP BY ALL),
stats AS MATERIALIZED (SELECT h.side, h.kind, h.id, h.direction, h.n, greatest(h.l - h.n + 1, 0) AS hyp, greatest(r.l - h.n + 1, 0) AS ref, coalesce(m.hit, 0) AS hit, h.l AS hl, r.l AS rl
  FROM (SELECT side, kind, id, direction, len(t) AS l, unnest(range(1, top + 1)) AS n FROM toks WHERE side <> 'r') h
  JOIN (SELECT kind, id, direction, len(t) AS l FROM toks WHERE side = 'r') r USING (kind, id, direction) LEFT JOIN m USING (side, kind, id, direction, n))"""


def _sides(cell: Callable[[str], str], kind: str, top: int) -> str:
    return " UNION ALL ".join(f"SELECT '{s}' AS side, '{kind}' AS kind, id, direction, {cell(x)} AS t, {top} AS top FROM preds" for s, x in (("a", "a"), ("b", "b"), ("r", "reference")))


_BLEU_ROWS = f"WITH {PREDICTIONS_SQL}, toks AS ({_sides(_tokens, 'w', 4)}), {_GRAMS}"
_CHRF_ROWS = f"""WITH {PREDICTIONS_SQL}, toks AS ({_sides(lambda x: f"string_split(regexp_replace({x}, '{chr(92)}s+', '', 'g'), '')", "c", 6)} UNION ALL {_sides(lambda x: f"flatten({_EDGE.format(x=x)})", "w", 2)}), {_GRAMS}"""
# Every order has n-grams and matches on this data, so the smoothing of zero matches has no part here.
_BLEU_SCORE = "min(CASE WHEN hl >= rl THEN 1 ELSE exp(1 - rl / hl) END) * exp(avg(ln(100.0::DOUBLE * hit / hyp)))"
_CHRF_SCORE = "100 * 5 * avg(hit / hyp) * avg(hit / ref) / (4 * avg(hit / hyp) + avg(hit / ref))"


@query("bleu", f"""{_BLEU_ROWS}, s AS (SELECT side, direction, n, CAST(sum(hit) AS DOUBLE) AS hit, CAST(sum(hyp) AS DOUBLE) AS hyp, CAST(sum(hl) AS DOUBLE) AS hl, CAST(sum(rl) AS DOUBLE) AS rl FROM stats GROUP BY ALL)
  SELECT side AS system, direction, round({_BLEU_SCORE}, 6) AS sacrebleu FROM s GROUP BY ALL""")
def _(spark, d):
    return _scored(spark, d, "sacrebleu")


@query("chrf", f"""{_CHRF_ROWS}, s AS (SELECT side, direction, kind, n, CAST(sum(hit) AS DOUBLE) AS hit, CAST(sum(hyp) AS DOUBLE) AS hyp, CAST(sum(ref) AS DOUBLE) AS ref FROM stats GROUP BY ALL)
  SELECT side AS system, direction, round({_CHRF_SCORE}, 6) AS chrf_plus_plus FROM s WHERE hyp > 0 AND ref > 0 GROUP BY ALL""")
def _(spark, d):
    return _scored(spark, d, "chrf_plus_plus")


@query("ter")
def _(spark, d):
    return _scored(spark, d, "ter")


def _scored(spark: SparkSession, d: str, metric: str) -> DataFrame:
    both = [predictions(spark, d, s).withColumn("system", F.lit(s)) for s in "ab"]
    stats = metrics.row_stats(both[0].unionByName(both[1]), [metric], ("system", "direction"))
    return stats.groupBy("system", "direction").agg(F.round(metrics.SCORES[metric](metrics._sums(metric)), 6).alias(metric))


@query("corpus_metrics")
def _(spark, d):
    return metrics.corpus_metrics(predictions(spark, d))


_SAMPLES = 1000
_DRAWN = f"""size AS (SELECT direction, count(*) AS n FROM preds GROUP BY 1), num AS (SELECT direction, id, row_number() OVER (PARTITION BY direction ORDER BY id) - 1 AS row FROM preds),
draws AS (SELECT direction, s AS sample, CAST(('0x' || substr(sha256('42:' || s || ':' || k), 1, 15)) AS BIGINT) % n AS row FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT *, unnest(range({_SAMPLES})) AS s FROM size))),
w AS (SELECT direction, sample, id, count(*) AS weight FROM draws JOIN num USING (direction, row) GROUP BY ALL),
ss AS (SELECT side, direction, sample, kind, n, CAST(sum(hit * weight) AS DOUBLE) AS hit, CAST(sum(hyp * weight) AS DOUBLE) AS hyp, CAST(sum(ref * weight) AS DOUBLE) AS ref FROM stats JOIN w USING (direction, id) GROUP BY ALL),
sc AS (SELECT side, direction, sample, {_CHRF_SCORE} AS score FROM ss WHERE hyp > 0 AND ref > 0 GROUP BY ALL),
s AS (SELECT side, direction, kind, n, CAST(sum(hit) AS DOUBLE) AS hit, CAST(sum(hyp) AS DOUBLE) AS hyp, CAST(sum(ref) AS DOUBLE) AS ref FROM stats GROUP BY ALL),
pt AS (SELECT side, direction, {_CHRF_SCORE} AS score FROM s WHERE hyp > 0 AND ref > 0 GROUP BY ALL)"""


@query("bootstrap_ci", f"""{_CHRF_ROWS}, {_DRAWN}, o AS (SELECT direction, list(score ORDER BY score) AS l FROM sc WHERE side = 'a' GROUP BY 1)
  SELECT direction, round(pt.score, 6) AS estimate, round(l[CAST(floor(0.025 * {_SAMPLES - 1}) AS INT) + 1], 6) AS lower, round(l[CAST(ceil(0.975 * {_SAMPLES - 1}) AS INT) + 1], 6) AS upper, {_SAMPLES} AS samples FROM pt JOIN o USING (direction) WHERE pt.side = 'a'""")
def _(spark, d):
    out = metrics.bootstrap_interval(predictions(spark, d), samples=_SAMPLES)
    return out.select("direction", *(F.round(c, 6).alias(c) for c in ("estimate", "lower", "upper")), "samples")


@query("paired_bootstrap", f"""{_CHRF_ROWS}, {_DRAWN}, df AS (SELECT direction, sample, a.score - b.score AS d FROM (SELECT * FROM sc WHERE side = 'a') a JOIN (SELECT * FROM sc WHERE side = 'b') b USING (direction, sample)),
  o AS (SELECT direction, list(d ORDER BY d) AS l, avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END) AS below, avg(CASE WHEN d >= 0 THEN 1.0 ELSE 0.0 END) AS above FROM df GROUP BY 1)
  SELECT direction, round(x.score, 6) AS score_a, round(y.score, 6) AS score_b, round(x.score - y.score, 6) AS difference_a_minus_b, round(l[CAST(floor(0.025 * {_SAMPLES - 1}) AS INT) + 1], 6) AS lower,
    round(l[CAST(ceil(0.975 * {_SAMPLES - 1}) AS INT) + 1], 6) AS upper, round(least(1.0, 2 * least(below, above)), 6) AS two_sided_p_approx
  FROM o JOIN (SELECT * FROM pt WHERE side = 'a') x USING (direction) JOIN (SELECT * FROM pt WHERE side = 'b') y USING (direction)""")
def _(spark, d):
    out = metrics.paired_bootstrap(predictions(spark, d, "a"), predictions(spark, d, "b"), samples=_SAMPLES)
    return out.select("direction", *(F.round(c, 6).alias(c) for c in ("score_a", "score_b", "difference_a_minus_b", "lower", "upper", "two_sided_p_approx")))


@query("contamination_exact", f"""WITH t AS (SELECT text, {_key("text")} AS k FROM documents WHERE text IS NOT NULL), b AS (SELECT text, {_key("text")} AS k FROM benchmark WHERE text IS NOT NULL)
  SELECT (SELECT count(*) FROM t WHERE text IN (SELECT text FROM b)) AS exact_rows, (SELECT count(*) FROM t WHERE k IN (SELECT k FROM b)) AS normalized_rows""")
def _(spark, d):
    return benchmarks.contamination_exact(texts(spark, d), table(spark, d, "benchmark"))


@query("contamination_contains", f"""WITH t AS (SELECT doc_id, ' ' || {_key("text")} || ' ' AS k FROM documents), b AS (SELECT item_id, ' ' || {_key("text")} || ' ' AS k FROM benchmark)
  SELECT DISTINCT doc_id, item_id FROM t JOIN b ON contains(t.k, b.k) WHERE trim(b.k) <> ''""")
def _(spark, d):
    return benchmarks.contamination_contains(texts(spark, d), table(spark, d, "benchmark"))


@query("rating_summary", f"WITH {RATINGS_SQL} SELECT lang, count(*) AS rows, round(avg(adequacy), 6) AS mean_adequacy, round(avg(quality), 6) AS share_quality, round(avg(toxic), 6) AS share_toxic FROM ratings GROUP BY 1")
def _(spark, d):
    rows = benchmarks.rating_summary(ratings(spark, d), ["lang"], ["adequacy"], ["quality", "toxic"])
    return rows.select("lang", "rows", *(F.round(c, 6).alias(c) for c in ("mean_adequacy", "share_quality", "share_toxic")))


@query("rating_agreement", f"""WITH {RATINGS_SQL}, i AS (SELECT doc_id, count(*) AS n, sum(adequacy)::DOUBLE AS s, sum(adequacy * adequacy)::DOUBLE AS q FROM ratings GROUP BY 1),
  x AS (SELECT count(*) AS everything, count_if(n > 1) AS items, sum(CASE WHEN n > 1 THEN n END) AS n, sum(CASE WHEN n > 1 THEN s END) AS s, sum(CASE WHEN n > 1 THEN q END) AS q, sum(CASE WHEN n > 1 THEN 2 * (n * q - s * s) / (n - 1) END) AS inside FROM i)
  SELECT round(1 - (inside / n) / (2 * (n * q - s * s) / (n * (n - 1))), 6) AS alpha, items, CAST(n AS BIGINT) AS ratings, round(items / everything, 6) AS share_double FROM x""")
def _(spark, d):
    return _agreement(spark, d, "interval")


@query("rating_agreement_ordinal", f"""WITH {RATINGS_SQL}, two AS (SELECT doc_id FROM ratings GROUP BY 1 HAVING count(*) > 1), p AS (SELECT * FROM ratings JOIN two USING (doc_id)),
  c AS (SELECT adequacy, count(*) AS n FROM p GROUP BY 1),
  d AS (SELECT a.adequacy AS x, b.adequacy AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, (sum(g.n) - (any_value(a.n) + any_value(b.n)) / 2.0::DOUBLE) ** 2 AS d2
    FROM c a JOIN c b ON a.adequacy <= b.adequacy JOIN c g ON g.adequacy BETWEEN a.adequacy AND b.adequacy GROUP BY 1, 2),
  m AS (SELECT doc_id, count(*) AS m FROM p GROUP BY 1),
  o AS (SELECT sum(d2 / (m - 1)) AS inside FROM p a JOIN p b USING (doc_id) JOIN m USING (doc_id) JOIN d ON d.x = least(a.adequacy, b.adequacy) AND d.y = greatest(a.adequacy, b.adequacy) WHERE a.reviewer_id <> b.reviewer_id AND a.adequacy <> b.adequacy),
  e AS (SELECT sum(2 * nx * ny * d2) AS across FROM d WHERE x < y), t AS (SELECT count(*) AS n FROM p)
  SELECT round(1 - (inside / n) / (across / (n * (n - 1.0::DOUBLE))), 6) AS alpha, (SELECT count(*) FROM two) AS items, n AS ratings,
    round((SELECT count(*) FROM two) / (SELECT count(DISTINCT doc_id) FROM ratings), 6) AS share_double FROM o, e, t""")
def _(spark, d):
    return _agreement(spark, d, "ordinal")


def _agreement(spark: SparkSession, d: str, level: str) -> DataFrame:
    rows = benchmarks.agreement(ratings(spark, d), "doc_id", "reviewer_id", "adequacy", level)
    return rows.select(F.round("alpha", 6).alias("alpha"), "items", "ratings", F.round("share_double", 6).alias("share_double"))


@query("rating_rules", f"WITH {RATINGS_SQL} SELECT 'adequacy' AS rule, count_if(adequacy NOT BETWEEN 1 AND 5) AS rows FROM ratings UNION ALL SELECT 'quality', count_if(quality NOT IN (0, 1)) FROM ratings UNION ALL SELECT 'toxic', count_if(toxic NOT IN (0, 1)) FROM ratings")
def _(spark, d):
    return benchmarks.rule_violations(ratings(spark, d), benchmarks.rating_rules(["adequacy"], ["quality", "toxic"]))


@query("training_lines", rf"SELECT {_strip('text')} AS value FROM conversations WHERE {_strip('text')} <> ''")
def _(spark, d):
    return vocabulary.training_lines(table(spark, d, "conversations"), "text")


@query("translate_copy", f"WITH {PREDICTIONS_SQL} SELECT id, direction, {_strip('source')} AS prediction FROM preds")
def _(spark, d):
    return benchmarks.translate(predictions(spark, d).drop("prediction")).select("id", "direction", "prediction")
