"""Sources and preprocessing: URIs, MIME types, hashes, sanitising."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions.scalar import trim_unicode

#: MIME types by extension.
EXTENSIONS = {"md": "text/markdown", "html": "text/html", "txt": "text/plain", "pdf": "application/pdf", "epub": "application/epub+zip", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
#: First bytes in hexadecimal, and what they mean.
MAGIC = {"25504446": "application/pdf", "89504E47": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "1F8B": "application/gzip", "504B0304": "application/zip"}
#: Speakers whose lines are dropped before enrichment.
SPEAKERS = "system|human|assistant|user"
#: Lines that hold one of these are dropped before enrichment.
INJECTIONS = (
    "ignore previous instructions", "ignore all previous", "disregard previous", "forget your instructions", "new instructions:", "system prompt:", "you are now", "act as if",
    "<|system|>", "<|user|>", "<|assistant|>", "###instruction", "[inst]", "[/inst]",
)
#: Files that tell what a ZIP archive is, the first that it has.
ARCHIVES = {"META-INF/container.xml": "application/epub+zip", "[Content_Types].xml": "application/vnd.openxmlformats"}


def scheme(uri: Column) -> Column:
    return (
        F.when(uri.rlike("^https?://"), "http").when(uri.startswith("raw://"), "raw").when(uri.startswith("s3://"), "s3").when(uri.startswith("gs://"), "gcs").when(uri.startswith("az://"), "azure").otherwise("file")
    )


def mime_by_name(uri: Column) -> Column:
    extension = F.lower(F.regexp_extract(uri, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("application/octet-stream")
    for k, v in EXTENSIONS.items():
        out = F.when(extension == k, v).otherwise(out)
    return out


def archive_kind(content: bytes | None) -> str | None:
    """What a ZIP archive holds by the names in its directory; one that cannot be read is application/zip."""
    if content is None:
        return None
    try:
        names = set(zipfile.ZipFile(io.BytesIO(content)).namelist())
    except Exception:  # whatever is wrong with the archive
        names = set()
    return next((kind for name, kind in ARCHIVES.items() if name in names), "application/zip")


def sniff(content: Column, hint: Column) -> Column:
    """First bytes win over the hint, and ZIP archives are told apart by their files; without either it is application/octet-stream."""
    head, out = F.hex(F.substring(content, 1, 8)), F.coalesce(hint, F.lit("application/octet-stream"))
    for k, v in MAGIC.items():
        found = F.udf(archive_kind, "string", useArrow=False)(F.when(head.startswith(k), content)) if v == "application/zip" else F.lit(v)  # other content stays in the JVM
        out = F.when(head.startswith(k), found).otherwise(out)
    return out


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def sanitised(text: Column, patterns: Sequence[str] = INJECTIONS) -> Column:
    """Without lines of speakers and lines that hold one of the patterns, which are taken literally, in any case."""

    def kept(line: Column) -> Column:
        return reduce(lambda c, p: c & ~F.contains(F.lower(line), F.lit(p.lower())), patterns, ~F.lower(F.trim(line)).rlike(f"^({SPEAKERS}):"))

    lines = F.filter(F.split(text, "\n"), kept)
    return F.trim(F.array_join(lines, "\n"))


def unchanged_first(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(content hash, smallest id that has it, number of rows): the deduplication of ingestion, hashes only."""
    return docs.groupBy(content_hash(F.col(text_col)).alias("content_hash")).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n_rows"))


def parsed_uri(uri: Column) -> Column:
    """struct(kind, bucket, key, display) of a URI; bucket and key only of cloud storage."""
    kind = scheme(uri)
    rest = F.regexp_replace(uri, "^(s3|gs|az)://", "")
    cloud = kind.isin("s3", "gcs", "azure")
    bucket, key = F.regexp_extract(rest, "^([^/]*)", 1), F.regexp_extract(rest, "^[^/]*/(?s)(.*)$", 1)
    front = F.when(kind == "s3", "s3").when(kind == "gcs", "gs").otherwise("az")
    return F.struct(kind.alias("kind"), F.when(cloud, bucket).alias("bucket"), F.when(cloud, key).alias("key"), F.when(cloud, F.concat(front, F.lit("://"), bucket, F.lit("/"), key)).otherwise(uri).alias("display"))


#: How resources of connectors are written.
CONNECTORS = {"google_drive": "gdrive", "notion": "notion", "confluence": "confluence"}


def connector_uri(provider: Column, resource: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, front in CONNECTORS.items():
        out = F.when(provider == name, F.concat(F.lit(f"{front}://"), resource)).otherwise(out)
    return out


def load_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as (source_uri, content, mime_type)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return df.select(F.col("path").alias("source_uri"), "content", sniff(F.col("content"), mime_by_name(F.col("path"))).alias("mime_type"))


def load_git(spark: SparkSession, checkout: str, glob: str = "*") -> DataFrame:
    """Files of a checkout that match, without Git's own."""
    return load_binary(spark, checkout, glob).where(~F.col("source_uri").rlike("/[.]git/"))


def load_cloud(spark: SparkSession, uri: str, glob: str = "*") -> DataFrame:
    """Objects below s3://, gs:// or az://, through the Hadoop connector that the cluster has for them."""
    front = {"s3://": "s3a://", "gs://": "gs://", "az://": "abfss://"}
    name = next((k for k in front if uri.startswith(k)), None)
    if name is None:
        raise ValueError(f"no cloud storage: {uri}")
    return load_binary(spark, front[name] + uri.removeprefix(name), glob)


def load_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def fetch_http(url: str, timeout: float = 30.0) -> tuple[bytes, str]:
    """Body and Content-Type."""
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as got:  # noqa: S310
        return got.read(), got.headers.get("Content-Type") or ""


def load_http(urls: DataFrame, fetch: Callable[[str], tuple[bytes, str]] = fetch_http, url_col: str = "url") -> DataFrame:
    """(source_uri, content, mime_type, error) of each URL, fetched in the tasks; a failure is an error in its row, not of the
    job. The MIME type is what stands before the first ';' of Content-Type."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    body, kind = fetch(url)
                    rows.append((url, body, kind.split(";")[0].strip() or "application/octet-stream", None))
                except Exception as e:  # whatever went wrong with this URL
                    rows.append((url, None, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["source_uri", "content", "mime_type", "error"])

    return urls.select(F.col(url_col).cast("string").alias("url")).mapInPandas(run, "source_uri string, content binary, mime_type string, error string")


def load_connector(spark: SparkSession, provider: str, resources: Sequence[str], fetch: Callable[[str, str], tuple[bytes, str]]) -> DataFrame:
    """Resources of a connector, fetched in the tasks by ``fetch(provider, resource)``."""
    if provider not in CONNECTORS:
        raise ValueError(f"unknown connector: {provider}")
    found = load_http(spark.createDataFrame([(r,) for r in resources], "url string"), lambda r: fetch(provider, r))
    return found.withColumn("source_uri", connector_uri(F.lit(provider), F.col("source_uri")))


def read_table(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """A table of one of Spark's formats."""
    if kind not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"unknown format: {kind}")
    return spark.read.options(**options).format(kind).load(path)


class Loaders:
    """Loaders by the kinds of URI that they support; the first that does is taken."""

    def __init__(self):
        self.known: list[tuple[str, set[str], Callable[..., DataFrame]]] = []

    def add(self, name: str, kinds: Sequence[str], load: Callable[..., DataFrame]) -> Loaders:
        self.known.append((name, set(kinds), load))
        return self

    def choose(self, uri: Column) -> Column:
        """Name of the loader of each URI, null for one that none supports."""
        out, kind = F.lit(None).cast("string"), scheme(uri)
        for name, kinds, _ in reversed(self.known):
            out = F.when(kind.isin(*kinds), name).otherwise(out)
        return out

    def load(self, spark: SparkSession, uri: str, **options) -> DataFrame:
        kind = "http" if uri.startswith(("http://", "https://")) else {"raw": "raw", "s3": "s3", "gs": "gcs", "az": "azure"}.get(uri.partition("://")[0] if "://" in uri else "", "file")
        for _, kinds, load in self.known:
            if kind in kinds:
                return load(spark, uri, **options)
        raise ValueError(f"no loader supports {uri}")


def default_loaders() -> Loaders:
    http = lambda spark, uri, **o: load_http(spark.createDataFrame([(uri,)], "url string"), **o)
    return Loaders().add("file", ["file"], load_binary).add("http", ["http"], http).add("cloud", ["s3", "gcs", "azure"], load_cloud)


#: Elements of a page that are no text.
_NO_TEXT = "(?is)<(script|style|head|nav|footer|aside|form)\\b[^>]*>.*?</\\1>"


def markdown(page: Column) -> Column:
    """Headings, list items, paragraphs and links of an HTML page as markdown; what is no text goes. Expressions only: a
    subset for clean pages (main text of any page: the subpackage for training data)."""
    x = F.regexp_replace(page, _NO_TEXT, "")
    for n in range(1, 7):
        x = F.regexp_replace(x, f"(?is)<h{n}\\b[^>]*>(.*?)</h{n}>", f"\n{'#' * n} $1\n")
    x = F.regexp_replace(x, '(?is)<a\\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)")
    x = F.regexp_replace(F.regexp_replace(x, "(?i)<li\\b[^>]*>", "\n- "), "(?i)</?(p|div|br|tr|ul|ol|table|article|section)\\b[^>]*>", "\n")
    x = F.regexp_replace(x, "<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return trim_unicode(F.regexp_replace(F.regexp_replace(x, "[ \\t]*\\n[ \\t]*", "\n"), "\\n{2,}", "\n\n"))


#: Preprocessors by name: from content and MIME type to text. "default" passes text on and turns pages to markdown.
PREPROCESSORS: dict[str, Callable[[Column, Column], Column]] = {
    "none": lambda text, mime: text,
    "default": lambda text, mime: F.when(mime == "text/html", markdown(text)).otherwise(text),
}


def preprocessed(docs: DataFrame, choice: DataFrame, catalog: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """docs (collection_id, text, mime_type, ...) with ``processed`` and ``error`` by each collection's preprocessor, choice
    (collection_id, preprocessor): collections without one or with an unknown one get "default"; empty output is an error."""
    known = catalog or PREPROCESSORS
    name = F.coalesce(F.when(F.col("preprocessor").isin(*known), F.col("preprocessor")), F.lit("default"))
    out = F.lit(None).cast("string")
    for k, f in known.items():
        out = F.when(name == k, f(F.col("text"), F.col("mime_type"))).otherwise(out)
    met = docs.join(choice.select("collection_id", "preprocessor").dropDuplicates(["collection_id"]), "collection_id", "left")
    met = met.withColumn("processed", out).drop("preprocessor")
    return met.withColumn("error", F.when(F.trim(F.coalesce("processed", F.lit(""))) == "", "empty output"))


def canonical_blocks(sidecar: Column) -> Column:
    """array of struct(id, kind, text, page) from a canonical JSON sidecar; bad JSON has none."""
    found = F.from_json(sidecar, "blocks array<struct<id:string,kind:string,text:string,page:int>>")["blocks"]
    return F.coalesce(found, F.array().cast("array<struct<id:string,kind:string,text:string,page:int>>"))
