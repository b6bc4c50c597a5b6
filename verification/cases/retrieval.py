from pyspark.sql import Window
from pyspark.sql import functions as F

from surveyalign.functions.vectors import cosine
from surveyalign.operators import retrieval as R
from surveyalign.operators.features import TabularEncoder
from surveyalign.operators.inference import retrieve_evidence
from surveyalign.operators.sampling import split_test_pool_fewshot
from surveyalign.session import shared_dir
from surveyalign.streaming.memory_feed import feed_subgroup_errors, read_subgroup_errors
from verification import survey_tables as st
from verification.cases import case
from verification.cases.features import mode_mean_prototypes, scaled_columns

_SCALED = ", ".join(f"round(z{i}, 6) AS z{i}" for i in range(1, 9))


def split(spark, sf):
    return st.stored(spark, sf, "split", lambda: split_test_pool_fewshot(st.clean_2022(spark, sf), fewshot_ratio=0.05))


def parts(spark, sf):
    """(encoder of the first survey, its memory, few-shot memory, encoded test trips), the encoder fitted once per session"""
    def build():
        past = st.clean_2011(spark, sf)
        historical, encoder = R.build_memory(past)
        rows = split(spark, sf)
        few, _ = R.build_memory(rows.where("split = 'few_shot'").drop("split"), encoder)
        test = encoder.transform(rows.where("split = 'test'").drop("split"))
        return encoder, historical, few, test
    return st.stored_object(spark, sf, "parts", build)


def indexes(spark, sf):
    """Indexes of the first survey (4 neighbours) and of the few-shot trips (8), built once per session."""
    def build():
        _encoder, historical, few, _test = parts(spark, sf)
        return R.build_index(historical, 4), R.build_index(few, 8)
    return st.stored_object(spark, sf, "indexes", build)


@case("build_memory", f"SELECT case_id, main_mode, {_SCALED} FROM fx_scaled WHERE survey_year = 2011")
def _(spark, sf):
    memory, _encoder = R.build_memory(st.clean_2011(spark, sf))
    return memory.select("case_id", "main_mode", *scaled_columns())


@case("update_memory", f"""SELECT s.case_id, s.survey_year, {_SCALED} FROM fx_scaled s LEFT JOIN fx_split p USING (case_id)
WHERE s.survey_year = 2011 OR p.split = 'few_shot'""")
def _(spark, sf):
    """The first survey's memory with the few-shot trips appended."""
    memory, encoder = R.build_memory(st.clean_2011(spark, sf))
    memory, _encoder = R.update_memory(memory, split(spark, sf).where("split = 'few_shot'").drop("split"), encoder)
    return memory.select("case_id", "survey_year", *scaled_columns())


_ERRORS = """SELECT age_group, abs(avg(CASE WHEN main_mode = predicted_mode THEN 1.0 ELSE 0.0 END) - {0}) AS error FROM fx_valid {1} GROUP BY age_group"""


@case("upsert_subgroup_errors", f"""
SELECT COALESCE(n.age_group, o.age_group) AS age_group, round(COALESCE(n.error, o.error), 6) AS error
FROM ({_ERRORS.format('1.0', '')}) o FULL JOIN ({_ERRORS.format('0.5', 'WHERE age_group <= 3')}) n ON o.age_group = n.age_group""")
def _(spark, sf):
    valid = st.predictions(spark, sf).where("predicted_mode >= 1")

    def errors(df, level):
        hit = F.avg((F.col("main_mode") == F.col("predicted_mode")).cast("double"))
        return df.groupBy("age_group").agg(F.abs(hit - level).alias("error"))

    merged = R.upsert_subgroup_errors(errors(valid, 1.0), errors(valid.where("age_group <= 3"), 0.5), ["age_group"])
    return merged.select("age_group", F.round("error", 6).alias("error"))


@case("feed_subgroup_errors", f"""
SELECT COALESCE(n.age_group, o.age_group) AS age_group, round(COALESCE(n.error, o.error), 6) AS error
FROM ({_ERRORS.format('1.0', '')}) o FULL JOIN ({_ERRORS.format('0.5', 'WHERE age_group <= 3')}) n ON o.age_group = n.age_group""")
def _(spark, sf):
    """The same errors as two arrivals of a stream; the second replaces the subgroups it names."""
    valid = st.predictions(spark, sf).where("predicted_mode >= 1")
    source, path, marks = (shared_dir(spark, n) for n in ("arriving", "errors", "marks"))
    for rows, level in ((valid, 1.0), (valid.where("age_group <= 3"), 0.5)):
        hit = F.avg((F.col("main_mode") == F.col("predicted_mode")).cast("double"))
        errors = rows.groupBy("age_group").agg(F.abs(hit - level).alias("error"))
        errors.write.mode("append").parquet(source)
        feed_subgroup_errors(spark.readStream.schema(errors.schema).parquet(source), path, marks, ["age_group"]).awaitTermination()
    return read_subgroup_errors(spark, path).select("age_group", F.round("error", 6).alias("error"))


@case("cosine_similarity", """
SELECT e.vec_id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.center), 6) AS similarity
FROM embeddings e JOIN (
  SELECT label, list(m ORDER BY i) AS center FROM (
    SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, LATERAL unnest(range(1, len(embedding) + 1)) AS r(i) GROUP BY label, i)
  GROUP BY label) c ON e.label = c.label""")
def _(spark, sf):
    """Every vector against the mean vector of its label."""
    vectors = st.table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centers = means.groupBy("label").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center"))
    return vectors.join(centers, "label").select(
        "vec_id", "label", F.round(cosine(F.col("embedding"), F.col("center")), 6).alias("similarity"))


@case("shift_score", "SELECT case_id, CASE WHEN survey_year >= 2022 THEN 1.0 ELSE 0.5 END::DOUBLE AS shift FROM fx_clean")
def _(spark, sf):
    return st.clean(spark, sf).select("case_id", R.shift_score(F.col("survey_year")).alias("shift"))


_PRIORITY = f"LEFT JOIN ({_ERRORS.format('0.5', 'WHERE age_group <= 3')}) e USING (age_group)"


def _subgroup_errors(spark, sf):
    hit = F.avg((F.col("main_mode") == F.col("predicted_mode")).cast("double"))
    return st.predictions(spark, sf).where("predicted_mode >= 1 AND age_group <= 3").groupBy("age_group").agg(F.abs(hit - 0.5).alias("error"))


@case("priority_score", f"""
SELECT case_id, round(COALESCE(error, 1.0), 6)::DOUBLE AS priority, CAST(ROW_NUMBER() OVER (PARTITION BY person_id, survey_year
  ORDER BY round(CASE WHEN survey_year >= 2022 THEN 0.3 ELSE 0.15 END::DOUBLE + 0.2::DOUBLE * COALESCE(error, 1.0), 9) DESC, case_id) AS INT) AS rank
FROM (SELECT c.*, e.error FROM fx_clean c {_PRIORITY})""")
def _(spark, sf):
    """Priorities from the errors of the age groups, and the order they give a person's trips."""
    memory = R.with_priority(st.clean(spark, sf), _subgroup_errors(spark, sf), ["age_group"])
    score = F.round(R.score_offset(F.col("survey_year"), F.col("priority")), 9)
    # A person has few trips.
    order = Window.partitionBy("person_id", "survey_year").orderBy(score.desc(), "case_id")
    return memory.select("case_id", F.round("priority", 6).alias("priority"), F.row_number().over(order).alias("rank"))


@case("retrieve_by_priority", f"""
SELECT query_id, CAST(pos AS INT) AS rank, best[pos]['c'] AS case_id, -best[pos]['s'] AS score
FROM (SELECT q.case_id AS query_id, min({{'s': -round(CAST(0.5 AS DOUBLE) * round({" + ".join(f"q.u{i} * c.u{i}" for i in range(1, 9))}, 10)
        + 0.3::DOUBLE + 0.2::DOUBLE * c.priority, 12), 'c': c.case_id}}, 8) AS best
      FROM (SELECT u.* FROM fx_unit u JOIN fx_split s USING (case_id) WHERE s.split = 'test') q
      CROSS JOIN (SELECT u.*, round(COALESCE(error, 1.0), 6)::DOUBLE AS priority FROM fx_unit u JOIN fx_split s USING (case_id) {_PRIORITY.replace('USING (age_group)', 'ON e.age_group = u.age_group')}
        WHERE s.split = 'few_shot') c GROUP BY q.case_id), LATERAL unnest(range(1, len(best) + 1)) AS r(pos)""")
def _(spark, sf):
    """Few-shot trips ranked by similarity, year and the errors of their age group."""
    _encoder, _historical, few, test = parts(spark, sf)
    ranked = R.with_priority(few, _subgroup_errors(spark, sf), ["age_group"]).withColumn("priority", F.round("priority", 6))
    found = R.retrieve_topk(test, R.build_index(ranked, 8), 8)
    return found.select("query_id", "rank", "case_id", "score")


_PAIR_DOT = " + ".join(f"a.u{i} * b.u{i}" for i in range(1, 9))


@case("retrieval_score", f"""
SELECT a.case_id AS query_id, b.case_id, round({_PAIR_DOT}, 10) AS similarity,
       round(0.5::DOUBLE * round({_PAIR_DOT}, 10) + CASE WHEN b.survey_year >= 2022 THEN 0.5::DOUBLE ELSE 0.35::DOUBLE END, 12) AS score
FROM fx_unit a JOIN fx_unit b ON a.person_id = b.person_id AND b.trip_no = a.trip_no + 1 AND a.survey_year = b.survey_year""")
def _(spark, sf):
    """Every trip against the next trip of the same person."""
    encoder = TabularEncoder.fit(st.clean_2011(spark, sf))
    rows = encoder.transform(st.clean(spark, sf)).select("case_id", "person_id", "survey_year", "trip_no", "features")
    following = rows.select("person_id", "survey_year", (F.col("trip_no") - 1).alias("trip_no"),
                            F.col("case_id").alias("next_id"), F.col("features").alias("next"))
    pairs = rows.join(following, ["person_id", "survey_year", "trip_no"])
    scored = R.score_pairs(pairs, "features", "next", "survey_year")
    return scored.select(F.col("case_id").alias("query_id"), F.col("next_id").alias("case_id"),
                         "similarity", "score")


@case("topk_per_query", """
SELECT q AS query_id, c AS case_id, CAST(rn AS INT) AS rank, round(s, 6) AS score FROM (
 SELECT l_suppkey AS q, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS c, l_extendedprice AS s,
 ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber) AS rn FROM lineitem)
WHERE rn <= 8""")
def _(spark, sf):
    scored = st.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("query_id"),
        (F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("case_id"),
        F.col("l_extendedprice").alias("score"))
    return R.topk_per_query(scored, 8).withColumn("score", F.round("score", 6))


@case("retrieve_topk", "SELECT query_id, rank, case_id, score FROM fx_hist_neighbours")
def _(spark, sf):
    """The four most similar trips of the first survey for every test trip."""
    _encoder, historical, _few, test = parts(spark, sf)
    found = R.retrieve_topk(test, R.build_index(historical, 4), 4)
    return found.select("query_id", "rank", "case_id", "score")


@case("query_corpus_pairs", """
SELECT query_id, rank, case_id, round((score - 0.5) / 0.5, 10) AS similarity FROM fx_few_neighbours""")
def _(spark, sf):
    """Every test trip is scored against every few-shot trip; the best eight pairs are kept."""
    _encoder, _historical, few, test = parts(spark, sf)
    found = R.retrieve_topk(test, R.build_index(few, 8), 8)
    return found.select("query_id", "rank", "case_id", F.round("similarity", 10).alias("similarity"))


@case("append_index", """
SELECT query_id, CAST(rn AS INT) AS rank, case_id, score FROM (
 SELECT query_id, case_id, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rn
 FROM (SELECT * FROM fx_hist_neighbours UNION ALL SELECT * FROM fx_few_neighbours)) WHERE rn <= 4""")
def _(spark, sf):
    """The first survey's index with the few-shot trips appended as a new generation."""
    _encoder, _historical, few, test = parts(spark, sf)
    index = R.append_index(indexes(spark, sf)[0], few)
    return R.retrieve_topk(test, index, 4).select("query_id", "rank", "case_id", "score")


def evidence(spark, sf):
    """What both memories and the prototypes say of every test trip; stored once per session."""
    def build():
        _encoder, _historical, _few, test = parts(spark, sf)
        return retrieve_evidence(test, *indexes(spark, sf), mode_mean_prototypes(spark, sf))
    return st.stored(spark, sf, "evidence", build)


@case("retrieve_evidence", """
SELECT query_id, memory, rank, n.case_id, score, c.main_mode, p.prototype_id
FROM (SELECT *, 'historical' AS memory FROM fx_hist_neighbours UNION ALL SELECT *, 'update' FROM fx_few_neighbours) n
JOIN fx_clean c ON c.case_id = n.case_id JOIN fx_nearest p ON p.case_id = query_id""")
def _(spark, sf):
    found = evidence(spark, sf)
    columns = ["case_id", "historical", "update", "prototype_id"]
    sides = F.array(F.struct(F.lit("historical").alias("memory"), F.col("historical").alias("found")),
                    F.struct(F.lit("update").alias("memory"), F.col("update").alias("found")))
    flat = (
        found.select(*columns).select(F.col("case_id").alias("query_id"), "prototype_id", F.inline(sides))
        .select("query_id", "prototype_id", "memory", F.inline("found")))
    return flat.select("query_id", "memory", "rank", "case_id", "score",
                       F.col("record.main_mode").alias("main_mode"), "prototype_id")
