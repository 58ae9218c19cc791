"""Assay descriptions, model configurations, predictions and documents as DataFrames."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.segments import object_at, segments_at, string_at
from ..functions.text import filled, path_stem, path_suffix, strip
from ..functions.urls import is_web
from ..store import Store, unused

#: What ``predictions`` adds.
PREDICTED = ("error", "prediction_protocol_name", "pred_library", "pred_segments", "pred_placeholders", "prediction", "raw_output")
MODEL_SCHEMA = "model_pos int, name string, model string, api string"


def plain_path(path: Column) -> Column:
    """A local file's path without its scheme; other stores keep theirs."""
    return F.regexp_replace(path, "^file:/+", "/")


def decoded(x: Column) -> Column:
    """Spark's _metadata has names and paths with escapes."""
    return F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def require_folder(spark: SparkSession, folder: str, what: str = "Input directory not found") -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        raise FileNotFoundError(f"{what}: {folder}")


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """file_name, path, value: whole UTF-8 files, those too whose names begin with a dot or an underscore."""
    shown = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).select(decoded(F.col("_metadata.file_name")).alias("file_name"), plain_path(decoded(F.col("_metadata.file_path"))).alias("path"), "value")
    copies = _hidden(spark, folder, pattern)
    if copies is None:
        return shown
    hidden = spark.read.text(copies, wholetext=True)
    name = F.regexp_replace(decoded(F.col("_metadata.file_name")), "^hidden", "")
    return shown.unionByName(hidden.select(name.alias("file_name"), F.concat(F.lit(folder.rstrip("/") + "/"), name).alias("path"), "value"))


def _hidden(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """Spark's readers pass over files with such names.  A folder of copies under other names, made by the file
    systems file by file; None if there are none."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    path = hadoop.Path(folder)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return None
    found = [f.getPath() for f in fs.listStatus(path) if f.isFile() and f.getPath().getName()[:1] in "._" and fnmatchcase(f.getPath().getName(), pattern)]
    if not found:
        return None
    store = Store(spark)
    for source in found:
        target = hadoop.Path(f"{store.root}/hidden", f"hidden{source.getName()}")
        hadoop.FileUtil.copy(fs, source, target.getFileSystem(conf), target, False, conf)
    return f"{store.root}/hidden"


def read_binaries(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """path, content: whole files, in no order."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder).select(plain_path(F.col("path")).alias("path"), "content")


def is_pdf(path: Column) -> Column:
    return F.lower(path_suffix(path)) == ".pdf"


def pdf_files(spark: SparkSession, folder: str, file: str | None = None) -> DataFrame:
    """path, content of a folder's PDFs in path order, or of one file.  A missing folder or file, a file
    of another kind and a folder without PDFs are errors."""
    if file is not None:
        require_folder(spark, file, "File not found")
        if not spark.range(1).select(is_pdf(F.lit(file))).first()[0]:
            raise ValueError(f"Expected a PDF file, got: {file}")
        return read_binaries(spark, file, "*")
    require_folder(spark, folder)
    found = read_binaries(spark, folder).orderBy("path")
    if found.select("path").isEmpty():
        raise FileNotFoundError(f"No PDFs found in {folder.rstrip('/')}/")
    return found


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path of each file of a folder, whose contents are not read; none if there is no folder."""
    try:
        require_folder(spark, folder)
    except FileNotFoundError:
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(plain_path(F.col("path")).alias("path"))


def listing_below(spark: SparkSession, folder: str) -> DataFrame:
    """path of each file in a folder and the folders inside."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(plain_path(F.col("path")).alias("path"))


def read_json_files(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """file_name, doc (VARIANT) for files named *.json.  Of doubled keys the last counts.  Files that are
    no JSON stop the query if ``strict``, else doc is null."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parse = F.parse_json if strict else F.try_parse_json
    return read_texts(spark, folder, "*.json").select("file_name", parse(F.col("value")).alias("doc"))


def _is_object(variant: str) -> Column:
    return F.coalesce(F.expr(f"schema_of_variant({variant}) LIKE 'OBJECT%'"), F.lit(False))


def protocols(files: DataFrame, texts: DataFrame, root: str = "") -> DataFrame:
    """Typed descriptions, one row per JSON object; other documents are skipped.  A text file is found by
    the PDF's stem, else by the id."""
    docs = files.filter(_is_object("doc")).select("file_name", "doc", F.expr(object_at("doc", "$.references")).alias("refs"))
    own_id, own_name = F.expr(string_at("doc", "$.protocol_id")), F.expr(string_at("doc", "$.protocol_name"))
    named = docs.withColumn("protocol_id", F.when(strip(own_id) != "", own_id).otherwise(path_stem(F.col("file_name"))))
    pdf, link = F.expr(string_at("refs", "$.protocol_pdf")), F.expr("if(schema_of_variant(variant_get(refs, '$.protocol_link', 'variant')) = 'STRING', variant_get(refs, '$.protocol_link', 'string'), NULL)")
    typed = named.select(
        "file_name", "protocol_id", F.when(strip(own_name) != "", own_name).otherwise(F.col("protocol_id")).alias("protocol_name"),
        F.when(strip(pdf) != "", F.when(pdf.startswith("/"), pdf).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), pdf))).alias("pdf_path"), link.alias("protocol_url"),
        F.expr(string_at("doc", "$.library_sequence")).alias("library_sequence"), F.expr(segments_at("doc", "$.segments")).alias("segments"), F.to_json(F.expr(object_at("doc", "$.placeholder_key"))).alias("placeholders"),
    )
    by_stem = texts.select(F.col("path").alias("stem_text"), path_stem(F.col("file_name")).alias("stem"))
    by_id = texts.select(F.col("path").alias("id_text"), path_stem(F.col("file_name")).alias("id_stem"))
    found = typed.join(by_stem, path_stem(F.col("pdf_path")) == F.col("stem"), "left").join(by_id, F.col("protocol_id") == F.col("id_stem"), "left")
    return found.withColumn("text_path", F.coalesce("stem_text", "id_text")).drop("stem_text", "stem", "id_text", "id_stem")


def load_protocols(spark: SparkSession, root: str, protocol_dir: str = "protocols", text_dir: str = "protocol_texts") -> DataFrame:
    """The descriptions of a folder in path order; relative folders are taken from the root."""
    within = lambda d: d if d.startswith("/") or "://" in d else f"{root.rstrip('/')}/{d}"
    require_folder(spark, within(protocol_dir), "Protocol directory does not exist")
    texts = read_texts(spark, within(text_dir)) if not listing(spark, within(text_dir)).isEmpty() else spark.createDataFrame([], "file_name string, path string, value string")
    return protocols(read_json_files(spark, within(protocol_dir)), texts, root).orderBy("file_name")


def with_contents(rows: DataFrame, pdfs: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds pdf_content and text_content, null where the file isn't there, and tells so in pdf_there and
    text_there.  Each file is read once, for the description that names it."""
    p = pdfs.select(F.col("path").alias("pdf_path"), F.col("content").alias("pdf_content"), F.lit(True).alias("pdf_there"))
    t = texts.select(F.col("path").alias("text_path"), F.col("value").alias("text_content"), F.lit(True).alias("text_there"))
    found = rows.join(p, "pdf_path", "left").join(t, "text_path", "left")
    return found.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("pdf_there", "text_there")})


def with_presence(rows: DataFrame, pdfs: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds pdf_there and text_there, without the contents."""
    pdf, text = unused([*rows.columns, "pdf_there", "text_there"], "pdf_at", "text_at")
    p = pdfs.select(F.col("path").alias(pdf)).distinct()
    t = texts.select(F.col("path").alias(text)).distinct()
    found = rows.join(p, F.col("pdf_path") == F.col(pdf), "left").join(t, F.col("text_path") == F.col(text), "left")
    return found.withColumns({"pdf_there": F.col(pdf).isNotNull(), "text_there": F.col(text).isNotNull()}).drop(pdf, text)


def models(spark: SparkSession, folder_or_json: str, inline: bool = False) -> DataFrame:
    """Model configurations from a JSON list or an object with a list ``models``.  An invalid entry stops
    the query with its number, counted from 1."""
    return model_rows(spark.createDataFrame([(folder_or_json,)], "value string") if inline else spark.read.text(folder_or_json, wholetext=True).select("value"))


def model_rows(text: DataFrame) -> DataFrame:
    """model_pos, name, model, api of each entry of the configuration in ``value``."""
    doc = text.select(F.parse_json("value").alias("doc")).select(F.expr("if(schema_of_variant(doc) LIKE 'OBJECT%', variant_get(doc, '$.models', 'variant'), doc)").alias("doc"))
    listed = doc.select(F.expr("if(schema_of_variant(doc) LIKE 'ARRAY%', cast(doc AS array<variant>), cast(raise_error('models must be a list') AS array<variant>))").alias("all"))
    each = listed.select(F.posexplode("all").alias("at", "entry"))
    value = lambda k: strip(F.expr(string_at("entry", f"$.{k}")))
    got = each.select((F.col("at") + 1).alias("model_pos"), _is_object("entry").alias("is_object"), value("name").alias("name"), F.coalesce(filled(value("model")), value("id")).alias("model"), value("api").alias("api"))
    wrong = ~F.col("is_object") | (F.col("model") == "") | (F.col("api") == "")
    sound = F.when(wrong, F.raise_error(F.concat(F.lit("invalid model entry "), F.col("model_pos").cast("string"))).cast("string"))
    return got.select(F.col("model_pos"), F.coalesce(sound, filled(F.col("name")), F.col("model")).alias("name"), "model", "api")


def predictions(rows: DataFrame, response: str = "response") -> DataFrame:
    """Untrusted responses (JSON text) to typed columns; what isn't a JSON object becomes an error."""
    v, r = unused([*rows.columns, *PREDICTED], "reply", "result")
    parsed = rows.withColumn(v, F.try_parse_json(F.col(response)))
    typed = parsed.withColumn(r, F.expr(object_at(f"`{v}`", "$.result")))
    fault = F.when(F.col(v).isNull(), F.lit("Invalid JSON from benchmark API")).when(~_is_object(f"`{v}`"), F.lit("Benchmark API returned a non-object JSON response"))
    return typed.withColumns({
        "error": F.coalesce(F.col("error"), fault) if "error" in rows.columns else fault,
        "prediction_protocol_name": F.expr(string_at(f"`{r}`", "$.protocol_name")), "pred_library": F.expr(string_at(f"`{r}`", "$.library_sequence")),
        "pred_segments": F.expr(segments_at(f"`{r}`", "$.segments")), "pred_placeholders": F.to_json(F.expr(object_at(f"`{r}`", "$.placeholder_key"))),
        "prediction": F.expr(f"to_json(variant_get(`{v}`, '$.result', 'variant'))"), "raw_output": F.expr(f"to_json(variant_get(`{v}`, '$.raw', 'variant'))"),
    }).drop(v, r)


def download_plan(files: DataFrame) -> DataFrame:
    """protocol_id, url, target_path, issue for every description with references; an old record may hold
    its URL where the PDF's path belongs."""
    kind = lambda path: F.expr(f"schema_of_variant(variant_get(doc, '$.references.{path}', 'variant'))")
    text = lambda path: F.expr(f"if(schema_of_variant(variant_get(doc, '$.references.{path}', 'variant')) = 'STRING', variant_get(doc, '$.references.{path}', 'string'), NULL)")
    wrong = lambda path: ~F.coalesce(kind(path).isin("STRING", "VOID"), F.lit(True))
    issue = F.when(F.col("doc").isNull(), "invalid JSON").when(wrong("protocol_link"), "references.protocol_link must be a string or null").when(wrong("protocol_pdf"), "references.protocol_pdf must be a string or null")
    kept = files.filter(F.col("doc").isNull() | _is_object("doc") & F.coalesce(F.expr("schema_of_variant(variant_get(doc, '$.references', 'variant')) LIKE 'OBJECT%'"), F.lit(False)))
    own_id = F.coalesce(F.expr(string_at("doc", "$.protocol_id")), F.lit(""))
    named = strip(F.when(strip(own_id) != "", own_id).otherwise(path_stem(F.col("file_name"))))
    moved = text("protocol_link").isNull() & is_web(text("protocol_pdf"))
    plan = kept.select("file_name", named.alias("protocol_id"), F.when(moved, text("protocol_pdf")).otherwise(text("protocol_link")).alias("url"), F.when(~moved, text("protocol_pdf")).alias("target_path"), issue.alias("issue"))
    return plan.withColumn("url", F.when(F.col("issue").isNull(), F.col("url"))).withColumn("target_path", F.when(F.col("issue").isNull(), F.col("target_path")))
