"""The outside: inference, downloads, PDF pages and OCR behind callables that are handed in.

Each seam runs Python on Arrow batches, because nothing in Spark can do the call; filter rows first.
A callable's exception becomes the row's error.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.text import strip
from ..operators.measure import tasks_of as measure_tasks
from ..store import unused
from .files import read_file, replace_file


class Request(NamedTuple):
    """One question to a model: kind is pdf, text or url; content is the PDF's or the text's bytes."""

    model: str
    api: str
    kind: str
    source: str
    content: bytes | None = None


#: A request to the reply's text.
Transport = Callable[[Request], str]


class HttpStatus(RuntimeError):
    """A reply with an error status."""

    def __init__(self, code: int, body: bytes):
        super().__init__(f"HTTP {code}: {body.decode('utf-8', errors='replace')}")


def multipart(fields: dict[str, str], files: Iterable[tuple[str, str, bytes, str]], boundary: str) -> bytes:
    """A multipart/form-data body; files are (field, file name, content, type)."""
    parts = [(f'form-data; name="{name}"', None, value.encode()) for name, value in fields.items()]
    parts += [(f'form-data; name="{field}"; filename="{name}"', kind, content) for field, name, content, kind in files]
    lines = []
    for disposition, kind, content in parts:
        head = f"--{boundary}\r\nContent-Disposition: {disposition}\r\n" + (f"Content-Type: {kind}\r\n" if kind else "")
        lines.append(head.encode() + b"\r\n" + content + b"\r\n")
    return b"".join(lines) + f"--{boundary}--\r\n".encode()


def request_parts(r: Request) -> tuple[dict[str, str], list[tuple[str, str, bytes, str]]]:
    """The fields and files of a request: a PDF goes as the file, a text or an address as a field."""
    if r.kind == "pdf":
        return {"model": r.model}, [("file", r.source.rpartition("/")[2], bytes(r.content), "application/pdf")]
    return {"model": r.model, r.kind: bytes(r.content).decode() if r.kind == "text" else r.source}, []


def http_transport(timeout: float = 360.0) -> Transport:
    """POST to the model's API."""

    def send(r: Request) -> str:
        import uuid
        from urllib import error, request

        boundary = uuid.uuid4().hex
        body = multipart(*request_parts(r), boundary)
        try:
            with request.urlopen(request.Request(r.api, body, {"Content-Type": f"multipart/form-data; boundary={boundary}"}), timeout=timeout) as reply:
                return reply.read().decode()
        except error.HTTPError as e:
            raise HttpStatus(e.code, e.read()) from e
        except error.URLError as e:
            raise RuntimeError(f"Request failed: {e.reason}") from e

    return send


def http_getter(timeout: float = 60.0, user_agent: str = "libgauge/1.0") -> Callable[[str], tuple[bytes, str | None, str]]:
    """GET: content, content type without parameters, and the address after redirections."""

    def get(url: str) -> tuple[bytes, str | None, str]:
        from urllib import request

        with request.urlopen(request.Request(url, headers={"User-Agent": user_agent}), timeout=timeout) as reply:
            return reply.read(), reply.headers.get_content_type(), reply.geturl()

    return get


SCALARS = ("string", "boolean", "byte", "short", "integer", "long", "float", "double", "date", "timestamp", "decimal")
REPLIES = "request_id string, response string, failure string, seconds double"


def identified(runs: DataFrame, name: str) -> DataFrame:
    """Runs with an id of the request, the same whenever the run is planned: a hash of the row's plain columns and
    contents, and a number among rows that are alike in all of them."""
    plain = [F.col(f"`{f.name}`") for f in runs.schema if f.dataType.typeName() in SCALARS and f.name not in CONTENTS]
    contents = [F.coalesce(F.sha2(F.col(c), 256), F.lit("")) for c in CONTENTS if c in runs.columns]
    alike = runs.withColumn(name, F.sha2(F.concat_ws("|", F.to_json(F.struct(*plain)), *contents), 256))
    return alike.withColumn(name, F.concat_ws("-", name, F.row_number().over(Window.partitionBy(name).orderBy(name)).cast("string")))


def journaled(spark: SparkSession, journal: str) -> DataFrame:
    """The replies that a journal holds: one JSON file a request."""
    path = spark._jvm.org.apache.hadoop.fs.Path(journal)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], REPLIES)
    return spark.read.schema(REPLIES).json(journal, pathGlobFilter="*.json")


def ask(requests: DataFrame, transport: Transport, pause: float = 0.0, journal: str | None = None) -> DataFrame:
    """REPLIES for each request (request_id, model, api, kind, source, content).  An exception is the request's
    failure.  With a journal each reply is a file there before the next request goes out, and a task
    that runs again takes what its first attempt has been told."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = 0
        for batch in batches:
            for request_id, *asked in zip(*(batch.column(c).to_pylist() for c in ("request_id", *Request._fields))):
                place = f"{journal}/{request_id}.json" if journal else None
                known = read_file(place) if place else None
                if known is None:
                    if sent and pause > 0:
                        time.sleep(pause)
                    sent, began, reply, failure = sent + 1, time.monotonic(), None, None
                    try:
                        reply = transport(Request(*asked))
                    except Exception as e:  # errors are data here
                        failure = str(e)
                    told = {"request_id": request_id, "response": reply, "failure": failure, "seconds": round(time.monotonic() - began, 3)}
                    if place:
                        replace_file(place, json.dumps(told).encode())
                else:
                    told = json.loads(known)
                yield pa.RecordBatch.from_pylist([told], schema=pa.schema([("request_id", pa.string()), ("response", pa.string()), ("failure", pa.string()), ("seconds", pa.float64())]))

    return requests.select("request_id", *Request._fields).mapInArrow(call, REPLIES)


CONTENTS = ("pdf_content", "text_content")


def infer(
    runs: DataFrame, transport: Transport, delay: float = 0.0, requests_at_once: int | None = None, journal: str | None = None, contents: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Runs (model, api, source_kind, source_used, error, optional pdf_content and text_content) with
    response, error, duration_seconds, without the contents.  Rows that already have an error aren't sent; a
    run that failed has used no source.  Only a request's own columns go to Python and only its reply comes
    back; all others are joined to it.

    ``requests_at_once`` bounds the partitions; with a ``delay`` it is 1 unless given, and each of N partitions
    waits N delays, so that one request goes out a delay.  ``journal`` is a folder for replies; what is there already is
    not asked again.  ``contents`` are the files (path, content) and texts (path, value): they meet the
    requests in the tasks that send them, each file once, however many models are asked about it."""
    if delay > 0 and not requests_at_once:
        requests_at_once = 1
    base = runs.drop("response", "duration_seconds")
    (mark,) = unused([*base.columns, *Request._fields, "request_id", "path"], "request")
    marked = identified(base, mark)
    kind = F.coalesce(F.col("source_kind"), F.lit("text")) if "source_kind" in base.columns else F.lit("text")
    held = {k: F.col(f"{k}_content").cast("binary") for k in ("pdf", "text") if f"{k}_content" in base.columns}
    content = F.coalesce(*(F.when(kind == k, c) for k, c in held.items()), F.lit(None).cast("binary"))
    requests = marked.filter(F.coalesce(F.col("error"), F.lit("")) == "").select(F.col(mark).alias("request_id"), "model", "api", kind.alias("kind"), F.col("source_used").alias("source"), content.alias("content"))
    known = journaled(runs.sparkSession, journal) if journal else None
    if known is not None:
        requests = requests.join(known.select("request_id"), "request_id", "left_anti")
    if contents is not None:
        files = contents[0].select("path", "content").unionByName(contents[1].select("path", F.encode("value", "UTF-8").alias("content"))).withColumnRenamed("content", "bytes")
        n = requests_at_once or measure_tasks(runs)
        requests = requests.repartition(n, "source").join(files.repartition(n, "path").hint("merge"), (F.col("source") == F.col("path")) & (F.col("kind") != "url"), "left").drop("content").withColumnRenamed("bytes", "content")
    elif requests_at_once:
        requests = requests.repartition(requests_at_once)
    replies = ask(requests, transport, delay * (requests_at_once or 1), journal)
    if known is not None:
        replies = replies.unionByName(known)
    reply, response, failure, seconds = unused(base.columns, "reply", "response_", "failure", "seconds")
    told = replies.select(F.col("request_id").alias(reply), F.col("response").alias(response), F.col("failure").alias(failure), F.col("seconds").alias(seconds))
    joined = marked.drop(*CONTENTS).join(told, F.col(mark) == F.col(reply), "left")
    error = F.coalesce(F.nullif(F.col("error"), F.lit("")), F.col(failure), F.col("error"))
    done = joined.withColumns({
        "source_used": F.when(F.coalesce(error, F.lit("")) != "", "").otherwise(F.col("source_used")), "error": error,
        "response": F.col(response), "duration_seconds": F.coalesce(F.col(seconds), F.lit(0.0)),
    })
    return done.select(*(F.col(f"`{c}`") for c in base.columns if c not in CONTENTS), "response", "duration_seconds")


def fetch(plan: DataFrame, get: Callable[[str], tuple[bytes, str | None, str]]) -> DataFrame:
    """Download rows (protocol_id, url): get gives content, content type and final URL."""
    schema = T.StructType([*plan.schema.fields, *(T.StructField(n, t) for n, t in (("content", T.BinaryType()), ("content_type", T.StringType()), ("final_url", T.StringType()), ("status", T.StringType()), ("message", T.StringType())))])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for url, name in zip(batch["url"], batch["protocol_id"]):
                if not url or pd.isna(url):
                    got.append((None, None, None, "skipped", f"{name}: no protocol_link URL"))
                    continue
                try:
                    content, kind, final = get(url)
                    got.append((content, kind, final, "downloaded", "") if content else (None, kind, final, "error", f"{name}: empty response from {url}"))
                except Exception as e:  # errors are data here
                    got.append((None, None, None, "error", f"{name}: request failed for {url} ({e})"))
            new = pd.DataFrame(got, index=batch.index, columns=["content", "content_type", "final_url", "status", "message"], dtype=object)
            yield pd.concat([batch, new], axis=1)[schema.names]

    return plan.mapInPandas(call, schema)


def register_page_reader(spark: SparkSession, read: Callable[[bytes], Iterable[str]], name: str = "pages_of") -> None:
    """A table function pages_of(content) with (page, text); pages count from 1, blank ones too."""

    class Pages:
        def eval(self, content: bytes):
            for k, text in enumerate(read(content or b""), 1):
                yield k, text

    spark.udtf.register(name, F.udtf(Pages, returnType="page: int, text: string"))


#: Recognisers of this Python worker, by what loads them.
_loaded: dict[bytes, Callable] = {}


def loaded(load: Callable[[], Callable[[bytes], str]]) -> Callable[[bytes], str]:
    """A recogniser, loaded once for a worker process and kept for all its tasks."""
    from pyspark import cloudpickle

    key = cloudpickle.dumps(load)
    if key not in _loaded:
        _loaded[key] = load()
    return _loaded[key]


def ocr(documents: DataFrame, load: Callable[[], Callable[[bytes], str]], split: Callable[[bytes], Iterable[bytes]] | None = None, page_break: str = "\n\n\n\n", tasks: int | None = None) -> DataFrame:
    """Documents (path, content) with text and error.  ``split`` makes a document's pages (each of a form that the
    recogniser takes); pages are dealt over all tasks and joined in their order, so that one long document isn't
    one task's work.  Without it a document is one page.  A page's error is its document's: the first page's
    counts.  A document without pages has the empty text."""
    pages_of = split or (lambda content: [content])
    pages_schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("image", pa.binary()), ("fault", pa.string())])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda *row: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, pages_schema)], schema=pages_schema)
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                yield one(path, 0, None, None)  # stands for the document itself
                try:
                    for k, image in enumerate(pages_of(content), 1):
                        yield one(path, k, image, None)
                except Exception as e:  # errors are data here
                    yield one(path, 0, None, str(e))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recognise = None
        for b in batches:
            texts, faults = [], b.column("fault").to_pylist()
            for k, image in enumerate(b.column("image").to_pylist()):
                text = None
                if image is not None:
                    try:
                        recognise = recognise or loaded(load)
                        text = recognise(image)
                    except Exception as e:  # errors are data here
                        faults[k] = str(e)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("page"), pa.array(texts, pa.string()), pa.array(faults, pa.string())], names=["path", "page", "text", "fault"])

    dealt = documents.select("path", "content").mapInArrow(pages, "path string, page int, image binary, fault string").repartition(tasks or measure_tasks(documents), "path", "page")
    told = dealt.mapInArrow(read, "path string, page int, text string, fault string")
    whole = told.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("page", "text")))).alias("pages"), F.min(F.when(F.col("fault").isNotNull(), F.struct("page", "fault"))).alias("worst"))
    text = strip(F.array_join(F.transform("pages", lambda p: p["text"]), page_break))
    return whole.select("path", F.when(F.col("worst").isNull(), text).alias("text"), F.col("worst.fault").alias("error"))


def pick_device(available: Callable[[str], bool], wanted: str | None = None) -> str:
    """The wanted device if it is there; else the first of CUDA, MPS and CPU."""
    if wanted is not None:
        if wanted != "cpu" and not available(wanted):
            raise ValueError(f"device {wanted} is not available")
        return wanted
    return next(d for d in ("cuda", "mps", "cpu") if d == "cpu" or available(d))


def require_module(name: str, hint: str):
    """An optional dependency, or an error that says how to get it."""
    import importlib

    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise RuntimeError(f"Missing dependency '{name}'. Install it with: {hint}") from e


def doctr_recogniser(device: str | None = None, det_arch: str = "db_resnet50", reco_arch: str = "crnn_vgg16_bn", images: bool = False) -> Callable[[], Callable[[bytes], str]]:
    """A ``load`` for ``ocr`` by docTR, where that and torch are installed: of whole PDFs, or of pages as ``pdf_images``
    gives them."""

    def load() -> Callable[[bytes], str]:
        torch = require_module("torch", "pip install torch torchvision")
        require_module("doctr", "pip install 'python-doctr[torch]' pypdfium2")
        from doctr.io import DocumentFile
        from doctr.models import ocr_predictor

        there = {"cuda": torch.cuda.is_available, "mps": torch.backends.mps.is_available}
        where = torch.device(pick_device(lambda d: there[d](), device))
        predict = ocr_predictor(det_arch=det_arch, reco_arch=reco_arch, pretrained=True).to(where)
        return lambda content: predict(DocumentFile.from_images([content]) if images else DocumentFile.from_pdf(content)).render()

    return load


def pdf_pages(content: bytes) -> list[str]:
    """The text of each page by PyMuPDF, where that is installed."""
    with require_module("pymupdf", "pip install pymupdf").open(stream=content, filetype="pdf") as document:
        return [page.get_text() for page in document]


def pdf_images(content: bytes, dpi: int = 144) -> Iterator[bytes]:
    """Each page as a PNG by PyMuPDF, a ``split`` for ``ocr``."""
    with require_module("pymupdf", "pip install pymupdf").open(stream=content, filetype="pdf") as document:
        for page in document:
            yield page.get_pixmap(dpi=dpi).tobytes("png")
