"""Documents as rows: parse responses, plain text, binary files, caches, snapshots."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.sources import responses

MAX_BYTES = 5 * 1024 * 1024


def parse_responses(spark: SparkSession, path: str) -> DataFrame:
    """JSON parse responses to elements: path, ord, id, page, category, text, x, y, w, h (responses.elements_of)."""
    return responses.elements_of(responses.bodies(spark, path).drop("key"))


def text_elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each line that is not blank as one body element on page 1, numbered and placed by its line."""
    l = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("ord", "text")).where(F.trim("text") != "")
    return l.select("doc_id", "ord", F.lit(1).alias("page"), F.lit("body").alias("category"), "text", F.lit(0.1).alias("x"), (F.lit(0.1) * F.col("ord")).alias("y"), F.lit(0.8).alias("w"), F.lit(0.05).alias("h"))


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content, ext, key (of the parse cache), skip: why a file isn't read, if so."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    archive = ext.isin("docx", "hwpx", "pptx", "xlsx")
    nul = F.locate("\0", F.substring("content", 1, 512).cast("string")) > 0
    skip = F.when(F.col("length") > MAX_BYTES, "too large").when(~archive & nul, "binary")
    return f.select("path", "content", ext.alias("ext"), cache_key(F.col("content")).alias("key"), skip.alias("skip"))


def cache_key(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts."""
    return F.left(F.sha2(parts[0] if len(parts) == 1 else F.concat_ws("\n", *parts), 256), F.lit(16))


def cached(wanted: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(rows of wanted with what the cache has for their key, rows that it lacks)."""
    return wanted.join(cache, key), wanted.join(cache.select(key), key, "left_anti")


class _Html(HTMLParser):
    BLOCKS = {"p", "div", "br", "tr", "li", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "pre"}
    HIDDEN = {"script", "style", "head", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        if tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_text(html: str) -> str:
    p = _Html()
    p.feed(html or "")
    p.close()
    lines = (re.sub(r"[ \t\xa0]+", " ", x).strip().removesuffix("|").strip() for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


def decode(data: bytes) -> tuple[str, str]:
    for name in ("utf-8-sig", "utf-8", "cp949", "euc-kr"):
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1"), "latin-1"


def _xml_text(xml: str, paragraph: str) -> str:
    return unescape(re.sub(r"<[^>]+>", "", re.sub(rf"</{paragraph}>", "\n", xml)))


def archive_text(data: bytes, ext: str) -> str:
    """Text of docx (paragraphs, table cells), pptx (slides in order), hwpx (sections), xlsx (shared strings)."""
    wanted, end = {"docx": (r"word/document\.xml", "w:p"), "pptx": (r"ppt/slides/slide(\d+)\.xml", "a:p"), "hwpx": (r"Contents/section(\d+)\.xml", "hp:p"), "xlsx": (r"xl/sharedStrings\.xml", "si")}[ext]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(wanted, n)), key=lambda n: ([int(x) for x in re.findall(r"\d+", n)], n))
        texts = (_xml_text(re.sub(r"</w:tc>", " | </w:tc>", z.read(n).decode("utf-8", "replace")), end) for n in names)
        return "\n".join(x.strip() for t in texts for x in t.split("\n") if x.strip())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for data, ext in zip(b.column("content").to_pylist(), b.column("ext").to_pylist(), strict=True):
            try:
                if ext in ("docx", "pptx", "hwpx", "xlsx"):
                    out.append((archive_text(data, ext), ext, None))
                else:
                    text, encoding = decode(data)
                    out.append((html_text(text) if ext in ("html", "htm") else text, encoding, None))
            except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError, KeyError, ValueError) as e:  # damaged or encrypted
                out.append((None, None, str(e)))
        text, encoding, error = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(text, pa.string()), pa.array(encoding, pa.string()), pa.array(error, pa.string())], ["path", "text", "encoding", "error"])


def file_texts(files: DataFrame) -> DataFrame:
    """binary_files() to path, text, encoding, error; decoding and unpacking have no native form."""
    return files.where("skip IS NULL").select("path", "content", "ext").mapInArrow(_texts, "path string, text string, encoding string, error string")


def _htmls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([html_text(x) for x in b.column(1).to_pylist()], pa.string())], ["page_id", "text"])


def html_texts(pages: DataFrame) -> DataFrame:
    """pages: page_id, html. Cells joined by bars, block elements on lines of their own."""
    return pages.select("page_id", "html").mapInArrow(_htmls, "page_id long, text string")


def tag_stripped(html: Column) -> Column:
    """A native approximation: block ends become lines, other tags go."""
    blocks = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), r"(?i)<(/p|/div|br ?/?|/tr|/li|/h[1-6])>", "\n")
    plain = F.regexp_replace(F.regexp_replace(blocks, r"</t[dh]>", " | "), r"<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def law_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Law snapshot JSON files to (law, law_article)."""
    schema = "`법령명` string, `시행일` string, `법률번호` string, `조문` array<struct<`조`:string,`제목`:string,`항`:array<string>,full_text:string>>"
    r = spark.read.schema(schema).option("multiLine", True).json(path)
    key = F.regexp_replace("법령명", r"[\s·ㆍ「」]", "")
    a = r.select(key.alias("law_key"), F.posexplode("조문").alias("pos", "a"))
    number = lambda p: F.regexp_extract("a.조", p, 1).try_cast("int")
    articles = a.select("law_key", number(r"제\s*(\d+)\s*조").alias("article"), number(r"조의\s*(\d+)").alias("sub"), "pos", F.col("a.제목").alias("title"), F.col("a.항").alias("paragraphs"), F.col("a.full_text").alias("full_text"))
    laws = r.select(key.alias("law_key"), F.col("법령명").alias("name"), F.array_distinct(F.array(key, F.regexp_replace(key, "(법률|법)$", ""))).alias("aliases"))
    return laws, articles


def safe_names(files: DataFrame) -> DataFrame:
    """files: job, ord, name: adds safe_name, with _1, _2 before the ending where a job has the name already."""
    from pyspark.sql import Window

    clean = F.regexp_replace(F.element_at(F.split("name", r"[/\\]"), -1), r"[^0-9A-Za-z가-힣._-]", "_")
    k = F.row_number().over(Window.partitionBy("job", "clean").orderBy("ord")) - 1
    f = files.withColumn("clean", clean).withColumn("k", k)
    return f.withColumn("safe_name", F.when(F.col("k") == 0, F.col("clean")).otherwise(F.regexp_replace("clean", r"(\.[^.]*)?$", F.concat(F.lit("_"), F.col("k").cast("string"), F.lit("$1"))))).drop("clean", "k")
