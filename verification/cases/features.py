from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.functions.text import prototype_label
from surveyalign.operators import features as E
from surveyalign.operators import prototypes as P
from surveyalign.session import materialize
from verification import survey_tables as st
from verification.cases import case
from verification.oracle_views import VIEWS

_N = range(1, 9)


def scaled_columns(column="features", digits=6, n=8):
    return [F.round(F.col(column)[i], digits).alias(f"z{i + 1}") for i in range(n)]


_SCALED = ", ".join(f"round(z{i}, 6) AS z{i}" for i in _N)


@case("tabular_encoder", f"SELECT case_id, {_SCALED} FROM fx_scaled")
def _(spark, sf):
    """Fitted on the first survey, applied to both."""
    encoder = E.TabularEncoder.fit(st.clean_2011(spark, sf))
    return encoder.transform(st.clean(spark, sf)).select("case_id", *scaled_columns())


@case("encode_for_retrieval", "SELECT case_id, " + ", ".join(
    f"round((x{i} - avg(x{i}) OVER ()) / CASE WHEN stddev_pop(x{i}) OVER () = 0 THEN 1 ELSE stddev_pop(x{i}) OVER () END, 6) AS z{i}" for i in _N)
    + " FROM fx_raw_features WHERE survey_year = 2022")
def _(spark, sf):
    encoded, _encoder = E.encode_for_retrieval(st.clean_2022(spark, sf))
    return encoded.select("case_id", *scaled_columns())


_MODEL = ["x1", "x2", "x3", "x4", "x5", "x6", "jt", "x7", "x8"]


@case("encode_for_model", "SELECT case_id, " + ", ".join(
    f"round(({x} - avg({x}) OVER ()) / CASE WHEN stddev_pop({x}) OVER () = 0 THEN 1 ELSE stddev_pop({x}) OVER () END, 6) AS z{i}" for i, x in enumerate(_MODEL, 1))
    + """ FROM (SELECT *, COALESCE(journey_time, (SELECT median(journey_time) FROM fx_clean WHERE survey_year = 2022)) AS jt
FROM fx_raw_features WHERE survey_year = 2022)""")
def _(spark, sf):
    encoded, _encoder = E.encode_for_model(st.clean_2022(spark, sf))
    return encoded.select("case_id", *scaled_columns(n=9))


def _ordinal(column):
    return (f"CAST(COALESCE((SELECT r FROM (SELECT v, ROW_NUMBER() OVER (ORDER BY v) - 1 AS r FROM (SELECT DISTINCT CAST({column} AS STRING) AS v "
            f"FROM fx_unified WHERE survey_year = 2022)) k WHERE k.v = CAST(u.{column} AS STRING)), 0) AS INT) AS {column}")


@case("ordinal_encoder", "SELECT case_id, " + ", ".join(_ordinal(c) for c in fv.CATEGORICAL_COLUMNS) + " FROM fx_unified u")
def _(spark, sf):
    """Fitted on the second survey, which lacks the income codes of the first."""
    df = st.unified(spark, sf)
    encoder = E.OrdinalEncoder().fit(df.where("survey_year = 2022"))
    return encoder.transform(df).select("case_id", *fv.CATEGORICAL_COLUMNS)


@case("kmeans", f"""
SELECT count(*) AS n_rows, {fv.N_PROTOTYPES} AS n_clusters, true AS centers_are_means FROM fx_clean WHERE survey_year = 2011""")
def _(spark, sf):
    """Every centre is the mean of the rows that are nearest to it, up to the stopping distance."""
    encoded, _encoder = E.encode_for_retrieval(st.clean_2011(spark, sf))
    clustering = P.kmeans(encoded)
    assigned = P.assign_prototype(encoded, clustering)
    means = assigned.groupBy("prototype_id").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("features")[i]) for i in range(8)]).alias("mean"))
    center = F.get(F.array(*[F.lit(c) for c in clustering.centers]), F.col("prototype_id"))
    moved = F.sqrt(F.aggregate(F.zip_with("mean", center, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y))
    return means.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).cast("int").alias("n_clusters"), (F.max(moved) <= 0.003 + 1e-9).alias("centers_are_means"))


_CLUSTER = "CAST((age_group * 2 + sex) % 10 AS INT)"
_DEMO = ["car_availability", "age_group", "employment_status", "trip_purpose", "sex", "departure_period"]
_PROTO = f"""SELECT {_CLUSTER} AS prototype_id, count(*) AS n_samples,
 {", ".join(f"avg({c}) AS mean_{c}" for c in _DEMO)},
 {", ".join(f"count(*) FILTER (WHERE main_mode = {m}) / count(*) AS mode_{m}" for m in fv.MODES)},
 {", ".join(f"count(*) FILTER (WHERE trip_purpose = {p}) / count(*) AS purpose_{p}" for p in fv.PURPOSES)}
 FROM fx_clean WHERE survey_year = 2011 GROUP BY {_CLUSTER}"""
_LABEL = """CASE round_even(mean_age_group, 0) WHEN 1 THEN '0-14' WHEN 2 THEN '15-24' WHEN 3 THEN '25-44' WHEN 4 THEN '45-64' WHEN 5 THEN '65+' ELSE 'Middle-aged' END
 || ' ' || CASE round_even(mean_employment_status, 0) WHEN 1 THEN 'Full-time' WHEN 2 THEN 'Part-time' WHEN 3 THEN 'Self-emp' WHEN 4 THEN 'Student' WHEN 5 THEN 'Homemaker' WHEN 6 THEN 'Retired' WHEN 7 THEN 'Other' ELSE 'Employed' END
 || ' (' || CASE round_even(mean_car_availability, 0) WHEN 0 THEN 'No car' WHEN 1 THEN '1 car' WHEN 2 THEN '2+ cars' ELSE 'No car' END || ')'"""


def _clustered(spark, sf):
    cluster = ((F.col("age_group") * 2 + F.col("sex")) % 10).cast("int")
    return st.clean_2011(spark, sf).withColumn("prototype_id", cluster)


@case("build_prototypes", f"""SELECT prototype_id, n_samples, {", ".join(f"round(mean_{c}, 6) AS mean_{c}" for c in _DEMO)},
 {", ".join(f"round(mode_{m}, 6) AS mode_{m}" for m in fv.MODES)}, {", ".join(f"round(purpose_{p}, 6) AS purpose_{p}" for p in fv.PURPOSES)}
 FROM ({_PROTO})""")
def _(spark, sf):
    """Summaries of clusters given by a column."""
    summary = P.summarize_prototypes(_clustered(spark, sf))
    return summary.select(
        "prototype_id", "n_samples",
        *[F.round(F.col("demographic_summary")[c], 6).alias(f"mean_{c}") for c in _DEMO],
        *[F.round(F.col("mode_share")[m], 6).alias(f"mode_{m}") for m in fv.MODES],
        *[F.round(F.col("purpose_share")[p], 6).alias(f"purpose_{p}") for p in fv.PURPOSES])


@case("prototype_label", f"SELECT prototype_id, {_LABEL} AS semantic_label FROM ({_PROTO})")
def _(spark, sf):
    means = _clustered(spark, sf).groupBy("prototype_id").agg(*[F.avg(c).alias(c) for c in _DEMO])
    label = prototype_label(F.col("age_group"), F.col("employment_status"), F.col("car_availability"))
    return means.select("prototype_id", label.alias("semantic_label"))


_CENTERS = "(SELECT main_mode, " + ", ".join(f"avg(z{i}) AS c{i}" for i in _N) + " FROM fx_scaled WHERE survey_year = 2011 GROUP BY main_mode)"
_DIST = " + ".join(f"(z{i} - c{i}) * (z{i} - c{i})" for i in _N)

# Nearest of nine centres, the mean vectors of the modes in the first survey, and what they summarise.
_NEAR = [f"d{j}" for j in range(9)]
VIEWS["fx_nearest"] = f"""
SELECT case_id, CAST(CASE {" ".join(f"WHEN round({d}, 9) = near THEN {j}" for j, d in enumerate(_NEAR))} END AS INT) AS prototype_id,
  round(sqrt(CASE {" ".join(f"WHEN round({d}, 9) = near THEN {d}" for d in _NEAR)} END), 6) AS distance FROM (
 SELECT *, least({", ".join(f"round({d}, 9)" for d in _NEAR)}) AS near FROM (
  SELECT s.case_id, {", ".join(f"({_DIST.replace('c', 'cs[%d].c' % (j + 1))}) AS d{j}" for j in range(9))}
  FROM fx_scaled s CROSS JOIN (SELECT list({{{", ".join(f"'c{i}': c{i}" for i in _N)}}} ORDER BY main_mode) AS cs FROM {_CENTERS}) c))"""
VIEWS["fx_proto"] = (
    _PROTO.replace(f"GROUP BY {_CLUSTER}", "GROUP BY prototype_id").replace(f"{_CLUSTER} AS prototype_id", "prototype_id")
    .replace("FROM fx_clean", "FROM fx_clean JOIN fx_nearest USING (case_id)"))
_SUMMARY = f"""'Behavioral Group ' || CAST(prototype_id AS STRING) || ': ' || {_LABEL} || chr(10)
 || '  Size: ' || format('{{:,}}', n_samples) || ' historical travelers' || chr(10) || '  Mode share (2011): ' || concat_ws(', ',
 {", ".join(f"CASE WHEN mode_{m} > 0 THEN '{name}=' || printf('%.1f', mode_{m} * 100) || '%' END" for m, name in fv.MODE_LABELS.items())})"""
VIEWS["fx_summary"] = f"SELECT prototype_id, {_SUMMARY} AS summary FROM fx_proto"


def mode_mean_prototypes(spark, sf):
    """Prototypes around the mean vectors of the modes, which SQL can state too."""
    past = st.clean_2011(spark, sf)
    encoder = E.TabularEncoder.fit(past)
    encoded = encoder.transform(past)
    means = encoded.groupBy("main_mode").agg(F.array(*[F.avg(F.col("features")[i]) for i in range(8)]).alias("centroid"))
    clustering = P.Clustering.from_frame(means.select(F.col("main_mode").alias("prototype_id"), "centroid"))
    prototypes = P.summarize_prototypes(P.assign_prototype(encoded, clustering))
    return P.PrototypeMemory(encoder, clustering, materialize(P.with_summary(prototypes), "prototypes"))


@case("prototype_summary", f"SELECT prototype_id, {_SUMMARY} AS summary FROM ({_PROTO})")
def _(spark, sf):
    return P.with_summary(P.summarize_prototypes(_clustered(spark, sf))).select("prototype_id", "summary")


@case("assign_prototype", """
SELECT case_id, prototype_id, distance, summary FROM fx_nearest JOIN fx_summary USING (prototype_id) WHERE case_id LIKE '2022%'""")
def _(spark, sf):
    memory = mode_mean_prototypes(spark, sf)
    assigned = P.attach_prototype(memory.encoder.transform(st.clean_2022(spark, sf)), memory)
    center = F.get(F.array(*[F.lit(c) for c in memory.clustering.centers]), F.col("prototype_id"))
    squared = F.aggregate(F.zip_with("features", center, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)
    return assigned.select("case_id", "prototype_id", F.round(F.sqrt(squared), 6).alias("distance"),
                           F.col("prototype_summary").alias("summary"))
