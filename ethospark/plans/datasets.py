"""Annotation and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.functions.time import DAY
from ethospark.operators import datasets, sampling
from ethospark.plans.base import OBS, H, observations, query, table

D = 24 * H


@query("SELECT event_id AS frame, epoch_us(ts) + round((event_id % 50) * 1e6 / 25)::BIGINT AS us, event_type AS label, (value + 2 * value) / 2 AS x, (1.0 + 3.0)::DOUBLE / 2 AS y FROM events")
def annotation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean points of annotations by frame."""
    point = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    record = F.struct(F.col("label"), F.array(point(F.col("value"), 1.0), point(F.col("value") * 2, 3.0)).alias("points"))
    rows = observations(spark, sf_dir).select("event_id", "us", F.create_map((F.col("event_id") % 50).cast("string"), F.array(record)).alias("a"))
    out = datasets.annotation_points(rows, ["event_id"], "us", 25.0, "a")
    return out.select(F.col("event_id").alias("frame"), "us", "label", "x", "y")


@query("SELECT lang, count(*) AS n, round(avg(CASE WHEN l.doc_id IS NOT NULL THEN 1.0 ELSE 0 END), 6)::DOUBLE AS share FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang")
def annotated_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of the documents has a label."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.collect_list("quality").alias("labels"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<int>")))
    return datasets.annotated_share(rows, ["lang"], "labels").withColumn("share", F.round("share", 6))


@query("SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each label."""
    return datasets.histogram(observations(spark, sf_dir), "label")


@query("SELECT doc_id, true AS listed FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a list names, and the others."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return datasets.only_listed(docs, labels, "doc_id").withColumn("listed", F.lit(True)).unionByName(datasets.only_listed(docs, labels, "doc_id", False).withColumn("listed", F.lit(False)))


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) NOT IN ('2024-01-03', '2024-01-07')")
def without_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all dates but those on the skip list."""
    return datasets.without_dates(observations(spark, sf_dir).withColumn("date", F.to_date("ts")), "date", ["2024-01-03", "2024-01-07"]).select("event_id")


@query("SELECT doc_id, 'good' AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'bad' FROM labels WHERE quality = 0")
def labelled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders as one set with labels."""
    labels = table(spark, sf_dir, "labels")
    return datasets.labelled_union({"good": labels.where("quality = 1").select("doc_id"), "bad": labels.where("quality = 0").select("doc_id")})


@query(f"""WITH {OBS}, p AS (SELECT DISTINCT subject, (us // {D} % 32)::BIGINT AS x, (us // {H} % 24)::BIGINT AS y FROM obs), q AS (SELECT *, x * 24 + y AS p FROM p),
m AS (SELECT *, CASE WHEN p - lag(p) OVER w = 1 THEN 0 ELSE 1 END AS fresh FROM q WINDOW w AS (PARTITION BY subject ORDER BY p)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY subject ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM m),
r AS (SELECT subject, run, min(p) AS a, max(p) + 1 AS b, count(*) AS n, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM n GROUP BY ALL), g AS (SELECT *, a - coalesce(lag(b) OVER (PARTITION BY subject ORDER BY run), 0) AS gap FROM r)
SELECT subject, sum(n)::BIGINT AS area, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, string_agg(gap || ',' || n, ',' ORDER BY run) AS runs FROM g GROUP BY subject""")
def mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length codes of masks."""
    pixels = observations(spark, sf_dir).select("subject", (F.floor(F.col("us") / DAY) % 32).alias("x"), (F.floor(F.col("us") / (DAY // 24)) % 24).alias("y"))
    return datasets.mask_runs(pixels, ["subject"], "x", "y", 24).withColumn("runs", F.array_join(F.col("runs").cast("array<string>"), ","))


@query("""WITH i AS (SELECT event_type AS source, user_id AS image FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (ORDER BY source, image) AS new_id FROM i) SELECT event_id, new_id FROM events JOIN n ON source = event_type AND image = user_id""")
def merge_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of several sets with ids that are unique over all."""
    notes = observations(spark, sf_dir).select(F.col("label").alias("source"), F.col("subject").alias("image"), "event_id")
    return datasets.merge_annotations(notes.select("source", "image").distinct(), notes, "source", "image")[1].select("event_id", "new_id")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def last_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last rows of each track."""
    return datasets.last_k(observations(spark, sf_dir), ["subject"], ["us", "event_id"], 5).select("event_id")


@query(f"""WITH {OBS}, s AS (SELECT DISTINCT us // {D} AS night, subject % 30 AS room, subject FROM obs WHERE label = 'purchase')
SELECT a.night, a.room, a.subject, coalesce(string_agg(b.subject::VARCHAR, ',' ORDER BY b.subject), 'alone') AS companions FROM s a LEFT JOIN s b ON a.night = b.night AND a.room = b.room AND a.subject <> b.subject GROUP BY ALL""")
def companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who else is in an animal's room."""
    rows = observations(spark, sf_dir).where("label = 'purchase'").select(F.floor(F.col("us") / DAY).alias("night"), (F.col("subject") % 30).alias("room"), "subject")
    return datasets.companions(rows, ["night", "room"], "subject", F.lit("alone"))


@query(f"""WITH {OBS} SELECT event_id, us - us // {D} * {D} AS offset_us, CASE WHEN subject % 2 = 0 THEN 'view' ELSE label END AS identity, CASE WHEN label IN ('click', 'view') THEN label ELSE 'invalid' END AS folder FROM obs""")
def export_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets within the night, the single animal's label and the folder of an export."""
    known = F.when(F.col("subject") % 2 == 0, F.array(F.lit("view"))).otherwise(F.array(F.lit("view"), F.lit("click")))
    night = (F.floor(F.col("us") / DAY) * DAY).cast("long")
    named = F.array(F.lit("click"), F.lit("view"))
    return observations(spark, sf_dir).select("event_id", datasets.night_offset(F.col("us"), night).alias("offset_us"), datasets.single_animal(F.col("label"), known).alias("identity"), datasets.output_folder(F.col("label"), named).alias("folder"))


@query("SELECT doc_id, lang AS identity, (doc_id % 4)::INT AS camera, (2019 + doc_id % 6)::INT AS year, CASE WHEN doc_id % 6 IN (4, 5) THEN 'test' ELSE 'train' END AS part FROM documents")
def identity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity, camera and year from paths, split by year."""
    path = F.concat(F.lit("/data/"), F.col("lang"), F.lit("/camera"), F.col("doc_id") % 4, F.lit("_"), 2019 + F.col("doc_id") % 6, F.lit("-05-06_"), F.col("doc_id"), F.lit(".jpg"))
    rows = datasets.identity_files(table(spark, sf_dir, "documents").select("doc_id", "lang", path.alias("path")), "path")
    dated = datasets.split_by_year(rows.withColumn("date", F.make_date("year", F.lit(5), F.lit(6))), "date", [2023, 2024])
    return dated.select(F.regexp_extract("path", r"_(\d+)\.jpg$", 1).cast("long").alias("doc_id"), "identity", "camera", "year", "part")


@query("SELECT user_id AS subject, min(epoch_us(ts)) AS first_start, max(epoch_us(ts)) AS last_end, count(*) AS n FROM events GROUP BY user_id")
def video_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First start and last end of each camera's videos."""
    return datasets.bounds(observations(spark, sf_dir), ["subject"], "us", "us")


@query(f"""WITH {OBS}, d AS (SELECT DISTINCT label, us // {D} AS day FROM obs WHERE value > 150) SELECT day, true AS common FROM d WHERE label = 'error' AND day IN (SELECT day FROM d WHERE label = 'signup') UNION ALL SELECT day, false FROM d WHERE label = 'error' AND day NOT IN (SELECT day FROM d WHERE label = 'signup')""")
def date_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that two series share, and those that the first has alone."""
    days = observations(spark, sf_dir).where("value > 150").withColumn("day", F.floor(F.col("us") / DAY))
    a, b = days.where("label = 'error'"), days.where("label = 'signup'")
    return datasets.common_keys([a, b], ["day"]).withColumn("common", F.lit(True)).unionByName(datasets.missing_keys(a, b, ["day"]).withColumn("common", F.lit(False)))


@query("SELECT url, page_id FROM pages ORDER BY url, page_id LIMIT 20 OFFSET 40")
def listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a listing: paging is the feature."""
    return datasets.page_of(table(spark, sf_dir, "pages").select("url", "page_id"), ["url", "page_id"], 20, 2)


@query("SELECT event_id, label FROM (SELECT event_id, event_type AS label, row_number() OVER (PARTITION BY event_type ORDER BY sha256('11:' || event_id), event_id) AS r FROM events) WHERE r <= 40")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty rows of each label, the same ones in every run."""
    return sampling.sample(observations(spark, sf_dir), ["label"], ["event_id"], k=40, seed=11).select("event_id", "label")


@query("SELECT event_id, label FROM (SELECT event_id, event_type AS label, row_number() OVER (PARTITION BY event_type ORDER BY sha256('5:' || event_id), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r <= floor(n * 0.2)")
def seeded_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the rows of each label, the same ones in every run."""
    return sampling.sample(observations(spark, sf_dir), ["label"], ["event_id"], share=0.2, seed=5).select("event_id", "label")
