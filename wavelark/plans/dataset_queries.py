"""Catalogue, labels, reviews, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelark.functions.text import clean_text, normalise_class
from wavelark.operators import dataset as S
from wavelark.operators.ordered import row_index
from wavelark.plans.registry import query
from wavelark.sources import adapters as A
from wavelark.sources.metadata import numbered_urls
from wavelark.sources.sinks import select_classes

REC = """rec AS (SELECT doc_id::VARCHAR AS recording_id, 'rec_' || (doc_id % 500) || '.wav' AS file_name,
  '/audio/' || source || '/' || lpad(doc_id::VARCHAR, 9, '0') || '/rec_' || (doc_id % 500) || '.wav' AS path,
  lang AS class_name, source FROM documents),
kept AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY path) = 1),
meta AS (SELECT DISTINCT 'rec_' || doc_id || '.wav' AS file_name, lang || ' Quality ' || quality AS class_name
  FROM documents JOIN labels USING (doc_id))"""
# A third of the documents, by source, counts as already copied.
DONE = "source IN ('src0', 'src3', 'src6', 'src9', 'src12')"


def _recordings(spark, folder):
    return A.recordings_from_documents(spark, folder)


def _labelled(spark, folder):
    return S.homogenise(_recordings(spark, folder), A.metadata_from_documents(spark, folder))


def _done(spark, folder):
    return _recordings(spark, folder).filter(F.col("source").isin("src0", "src3", "src6", "src9", "src12"))


@query("unique_recordings", f"WITH {REC} SELECT recording_id, file_name, path, class_name FROM kept")
def unique(spark, folder):
    return S.dedupe_by_name(_recordings(spark, folder)).select("recording_id", "file_name", "path", "class_name")


@query(
    "duplicate_recordings",
    f"WITH {REC} SELECT recording_id, file_name, path FROM rec ANTI JOIN kept USING (file_name, path)",
)
def duplicates(spark, folder):
    return S.duplicate_names(_recordings(spark, folder)).select("recording_id", "file_name", "path")


@query(
    "class_from_path",
    """WITH p AS (SELECT page_id::VARCHAR AS recording_id, regexp_replace(url, '^https?://[^/]+/(en/)?', '') AS path FROM pages)
  SELECT recording_id, path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'unclassified' END AS class_name FROM p""",
)
def class_of_path(spark, folder):
    rows = A.recordings_from_pages(spark, folder).withColumn(
        "path", F.regexp_replace("path", r"^https?://[^/]+/(en/)?", "")
    )
    return S.with_class_from_path(rows).select("recording_id", "path", "class_name")


@query("listing_order", f"WITH {REC} SELECT class_name, file_name, path FROM rec ORDER BY ALL")
def listing(spark, folder):
    return S.listing(_recordings(spark, folder)).select("class_name", "file_name", "path")


@query(
    "audio_dir_counts",
    "SELECT source || '_' || lang AS directory, count(*) AS n_files FROM documents WHERE lang <> 'es' GROUP BY 1",
)
def dir_counts(spark, folder):
    ext = F.when(F.col("lang") == "es", ".txt").when(F.col("lang") == "en", ".WAV").otherwise(".flac")
    docs = A.table(spark, folder, "documents").select(
        F.concat(F.lit("/audio/"), "source", F.lit("_"), "lang", F.lit("/f"), F.col("doc_id").cast("string"), ext).alias("path")
    )
    return S.audio_dirs(docs, "/audio")


@query(
    "metadata_columns",
    """SELECT 'rec_' || doc_id || '.wav' AS file_name, lang || ' Quality ' || quality AS class_name
  FROM documents JOIN labels USING (doc_id)""",
)
def metadata(spark, folder):
    return S.metadata_rows(A.metadata_from_documents(spark, folder))


@query(
    "labelled_recordings",
    f"WITH {REC} SELECT k.recording_id, k.file_name, k.path, m.class_name FROM kept k JOIN meta m USING (file_name)",
)
def labelled(spark, folder):
    return _labelled(spark, folder).select("recording_id", "file_name", "path", "class_name")


@query(
    "metadata_without_file",
    f"""WITH {REC} SELECT 'rec_' || doc_id || '.wav' AS file_name, lang || ' Quality ' || quality AS class_name
  FROM documents JOIN labels USING (doc_id) WHERE 'rec_' || doc_id || '.wav' NOT IN (SELECT file_name FROM rec)""",
)
def without_file(spark, folder):
    return S.unmatched(A.metadata_from_documents(spark, folder), _recordings(spark, folder))


@query(
    "class_counts",
    f"WITH {REC} SELECT m.class_name, count(*) AS n_files FROM kept JOIN meta m USING (file_name) GROUP BY 1",
)
def counts(spark, folder):
    return S.class_counts(_labelled(spark, folder))


@query(
    "class_totals",
    f"""WITH {REC} SELECT count(*) AS total, count(DISTINCT m.class_name) AS n_classes
  FROM kept JOIN meta m USING (file_name)""",
)
def totals(spark, folder):
    return S.class_totals(_labelled(spark, folder))


@query(
    "files_not_copied_yet",
    f"""WITH {REC} SELECT recording_id, class_name, file_name FROM rec
  WHERE (class_name, file_name) NOT IN (SELECT class_name, file_name FROM rec WHERE {DONE})""",
)
def not_copied(spark, folder):
    rows = S.only_new(_recordings(spark, folder), _done(spark, folder), ["class_name", "file_name"])
    return rows.select("recording_id", "class_name", "file_name")


@query(
    "relabelled_recordings",
    """WITH d AS (SELECT DISTINCT source FROM documents),
  m AS (SELECT source, ' Group  ' || (substr(source, 4)::INTEGER % 7) || ' Sound ' AS raw FROM d)
  SELECT doc_id::VARCHAR AS recording_id, 'group_' || (substr(source, 4)::INTEGER % 7) || '_sound' AS class_name
  FROM documents JOIN m USING (source)""",
)
def relabelled(spark, folder):
    recs = _recordings(spark, folder).withColumn("directory", F.col("source"))
    group = (F.substring("directory", 4, 9).cast("int") % 7).cast("string")
    mapping = recs.select("directory").distinct().withColumn(
        "new_class", F.concat(F.lit(" Group  "), group, F.lit(" Sound "))
    )
    return S.relabel(recs, mapping).select("recording_id", "class_name")


@query(
    "normalised_class_names",
    r"""SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> ''), '_')) AS name
  FROM documents""",
)
def class_names(spark, folder):
    docs = A.table(spark, folder, "documents")
    return docs.select("doc_id", F.md5(normalise_class(F.col("text")).cast("binary")).alias("name"))


@query(
    "clean_columns",
    "SELECT doc_id, trim(source) AS source, trim(n_chars::VARCHAR) AS n_chars FROM documents",
)
def cleaned(spark, folder):
    docs = A.table(spark, folder, "documents").withColumn("source", F.concat(F.lit("  "), "source", F.lit(" ")))
    return docs.select("doc_id", clean_text("source").alias("source"), clean_text("n_chars").alias("n_chars"))


REVIEW = """dec AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'delete' WHEN toxic = 1 THEN 'skip' ELSE 'keep' END AS decision
  FROM labels)"""


def _review(spark, folder):
    recs = _recordings(spark, folder)
    labels = A.table(spark, folder, "labels").withColumn("recording_id", F.col("doc_id").cast("string"))
    decision = F.when(F.col("quality") == 0, "delete").when(F.col("toxic") == 1, "skip").otherwise("keep")
    decisions = recs.select("recording_id", "path").join(labels, "recording_id").select(
        "path", decision.alias("decision"), F.lit("reviewed").alias("class_name")
    )
    return recs, decisions


@query(
    "review_kept_chunks",
    f"WITH {REVIEW} SELECT doc_id::VARCHAR AS recording_id, 'reviewed' AS class_name FROM dec WHERE decision = 'keep'",
)
def kept(spark, folder):
    return S.kept_chunks(*_review(spark, folder)).select("recording_id", "class_name")


@query(
    "review_after_deletion",
    f"""WITH {REVIEW} SELECT doc_id::VARCHAR AS recording_id FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM dec WHERE decision = 'delete')""",
)
def after_deletion(spark, folder):
    return S.without_deleted(*_review(spark, folder)).select("recording_id")


@query("review_tally", f"WITH {REVIEW} SELECT decision, count(*) AS n FROM dec GROUP BY 1")
def tally(spark, folder):
    return S.decision_tally(_review(spark, folder)[1])


def split_sql(table: str, key: str, cls: str) -> str:
    return f"""rk AS (SELECT {key}::VARCHAR AS recording_id, {cls} AS class_name,
    row_number() OVER (PARTITION BY {cls} ORDER BY md5('42:' || {key}), {key}::VARCHAR) - 1 AS r,
    count(*) OVER (PARTITION BY {cls}) AS n FROM {table}),
  held AS (SELECT *, ceil((0.15::DOUBLE + 0.15::DOUBLE) * n) AS h FROM rk),
  split AS (SELECT recording_id, class_name, CASE WHEN n < 6 THEN CASE r WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END
    WHEN r < ceil(0.5 * h) THEN 'test' WHEN r < h THEN 'validation' ELSE 'train' END AS split FROM held)"""


@query(
    "split_assignment",
    f"WITH {split_sql('documents', 'doc_id', 'source')} SELECT recording_id, class_name, split FROM split",
)
def splits(spark, folder):
    recs = _recordings(spark, folder).withColumn("class_name", F.col("source"))
    return S.assign_splits(recs).select("recording_id", "class_name", "split")


@query(
    "split_sizes",
    f"""WITH {split_sql('documents', 'doc_id', 'source')} SELECT split, class_name, count(*) AS n_files
  FROM split GROUP BY ROLLUP (split, class_name)""",
)
def split_sizes(spark, folder):
    recs = _recordings(spark, folder).withColumn("class_name", F.col("source"))
    return S.split_report(S.assign_splits(recs))


@query(
    "split_files_not_written_yet",
    f"""WITH {split_sql('documents', 'doc_id', 'lang')} SELECT s.split, s.class_name, s.recording_id
  FROM split s WHERE s.recording_id NOT IN (SELECT doc_id::VARCHAR FROM documents WHERE {DONE})""",
)
def split_new(spark, folder):
    assigned = S.assign_splits(_recordings(spark, folder))
    written = assigned.filter(F.col("source").isin("src0", "src3", "src6", "src9", "src12"))
    return S.only_new(assigned, written, ["split", "class_name", "recording_id"]).select(
        "split", "class_name", "recording_id"
    )


@query(
    "stratified_train_test",
    """WITH rk AS (SELECT vec_id::VARCHAR AS recording_id, 'class_' || label AS class_name,
    row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id)) - 1 AS r,
    count(*) OVER (PARTITION BY label) AS n FROM embeddings)
  SELECT recording_id, class_name, CASE WHEN r < ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM rk""",
)
def stratified(spark, folder):
    return S.train_test(A.features_from_embeddings(spark, folder)).select("recording_id", "class_name", "split")


@query(
    "train_test_unstratified",
    """WITH rk AS (SELECT vec_id::VARCHAR AS recording_id, row_number() OVER (ORDER BY md5('42:' || vec_id)) - 1 AS r,
    count(*) OVER () AS n FROM embeddings)
  SELECT recording_id, CASE WHEN r < ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM rk""",
)
def unstratified(spark, folder):
    rows = S.train_test(A.features_from_embeddings(spark, folder), class_col=None)
    return rows.select("recording_id", "split")


@query(
    "selected_class_features",
    """SELECT vec_id::VARCHAR AS recording_id, 'class_' || label AS class_name, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total
  FROM embeddings WHERE label IN (1, 4, 7)""",
)
def class_features(spark, folder):
    rows = select_classes(A.features_from_embeddings(spark, folder), ["class_1", "class_4", "class_7"])
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return rows.select("recording_id", "class_name", (F.round(total, 6) + F.lit(0.0)).alias("total"))


@query(
    "url_list",
    """SELECT line_no, url, 'pages_' || line_no || '.wav' AS output_name
  FROM (SELECT row_number() OVER (ORDER BY page_id) AS line_no, url FROM pages) WHERE NOT contains(url, '?')""",
)
def urls(spark, folder):
    # Lines with a query string become blank ones: numbered, then skipped.
    line = F.when(F.contains("url", F.lit("?")), " ").otherwise(F.concat(F.lit(" "), "url"))
    lines = A.table(spark, folder, "pages").select("page_id", line.alias("value"))
    numbered = row_index(lines, [], F.floor(F.col("page_id") / 65536), ["page_id"], "line_no")
    return numbered_urls(numbered.withColumn("line_no", F.col("line_no") + 1), "pages")
