"""PDF files as rows: the streams of their pages, and the spans of text that these draw.

Tasks read a file's objects and inflate the content of its pages; what the content says is parsed by column
expressions: one pattern cuts it into operations, windows over a page carry font, size and line to the spans.

Cases: a file that isn't a PDF, is broken, encrypted or without pages, or has a page under another filter than Flate is one row
with an error, and the others go on; an empty file too. A page without text has no spans, and a file without any is a failure of `failures`.
Fonts are taken as one byte a character in the Windows code page 1252; composite fonts are an error of their file. Images are
skipped. A file is one value, held by one task at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PAGES = "path string, page int, content string, fonts map<string,string>, error string"

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_END = re.compile(rb"stream\r?\n|endobj")
_REF = re.compile(rb"(\d+)\s+\d+\s+R")

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)"
# Possessive loops, which Java runs without recursion, so that strings can be long.
STRING = r"\((?:[^\\()]++|\\[\s\S]|\((?:[^\\()]++|\\[\s\S])*+\))*+\)"
SHOWN = rf"(?:{STRING}|<[0-9A-Fa-f\s]*+>)"
OPERATION = rf"/[^\s/\[\]<>()]++\s+{NUMBER}\s+Tf|(?:{NUMBER}\s+){{2}}T[dD]|(?:{NUMBER}\s+){{6}}Tm|T\*|\bBT\b|{SHOWN}\s*(?:Tj|'|\")|\[(?:{SHOWN}|[^\]()<>]++)*+\]\s*TJ|{STRING}"
#: A shift to the left of so many thousandths of the size is a space.
GAP = -200
#: A task hands on pages once so many are read, or the files they are from have so many bytes.
BATCH_PAGES, BATCH_BYTES = 200, 4_000_000


class Broken(ValueError):
    """The file can't be read."""


def _objects(data: bytes) -> dict[int, tuple[bytes, bytes | None]]:
    """Number: (dictionary, stream), those within object streams too; of a number that repeats, the last."""
    found, at = {}, 0
    while m := _OBJECT.search(data, at):
        end = _END.search(data, m.end())
        if end is None:
            raise Broken("an object has no end")
        head, stream, at = data[m.end() : end.start()], None, end.end()
        if end[0] != b"endobj":
            length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
            stop = at + int(length[1]) if length else -1
            if stop < 0 or not data[stop : stop + 12].lstrip().startswith(b"endstream"):
                stop = data.find(b"endstream", at)
            if stop < 0:
                raise Broken("a stream has no end")
            stream, at = data[at:stop], stop
        found[int(m[1])] = (head, stream)
    for head, stream in list(found.values()):
        if stream is not None and re.search(rb"/Type\s*/ObjStm", head):
            body, first = _inflated(head, stream), int(re.search(rb"/First\s+(\d+)", head)[1])
            index = [int(x) for x in body[:first].split()]
            starts = index[1::2] + [len(body) - first]
            for k, n in enumerate(index[::2]):
                found.setdefault(n, (body[first + starts[k] : first + starts[k + 1]], None))
    return found


def _inflated(head: bytes, stream: bytes) -> bytes:
    named = re.findall(rb"/(\w+Decode)\b", head)
    if named not in ([], [b"FlateDecode"]) or b"/Predictor" in head:
        raise Broken("a filter isn't known")
    return zlib.decompressobj().decompress(stream) if named else stream


def _value(head: bytes, key: bytes, objects: dict) -> bytes:
    """The value of a key, resolved if it is a reference."""
    m = re.search(rb"/" + key + rb"\b\s*", head)
    if m is None:
        return b""
    ref = _REF.match(head, m.end())
    return objects.get(int(ref[1]), (b"", None))[0] if ref else head[m.end() :]


def _refs(head: bytes, key: bytes, objects: dict) -> list[int]:
    """The objects that a key names, one or an array."""
    m = re.search(rb"/" + key + rb"\s*(?:(\d+)\s+\d+\s+R|\[([^\]]*)\])", head)
    if m is None:
        return []
    if m[1] is None:
        return [int(n) for n in _REF.findall(m[2])]
    listed = objects.get(int(m[1]), (b"", None))
    return [int(n) for n in _REF.findall(listed[0])] if listed[1] is None and listed[0].strip().startswith(b"[") else [int(m[1])]


def _fonts(page: bytes, parent: bytes, objects: dict) -> dict[str, str]:
    resources = _value(page, b"Resources", objects) or parent
    named = re.match(rb"\s*<<(.*?)>>", _value(resources, b"Font", objects), re.DOTALL)
    fonts = {}
    for name, n in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", named[1] if named else b""):
        head = objects.get(int(n), (b"", None))[0]
        if re.search(rb"/Subtype\s*/Type0\b", head):
            raise Broken("a font is composite")
        base = re.search(rb"/BaseFont\s*/([^\s/<>]+)", head)
        fonts[name.decode("latin-1")] = base[1].decode("latin-1") if base else ""
    return fonts


def _read(data: bytes) -> list[tuple[str, dict[str, str]]]:
    """(content, fonts) of each page in order."""
    if b"%PDF-" not in data[:1024]:
        raise Broken("not a PDF")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise Broken("encrypted")
    objects = _objects(data)
    roots = [h for h, _ in objects.values() if re.search(rb"/Type\s*/Catalog\b", h)]
    left = [(n, b"") for h in roots[-1:] for n in _refs(h, b"Pages", objects)]
    out, seen = [], set()
    while left:
        n, parent = left.pop()
        if n in seen or n not in objects:
            raise Broken("the tree of pages is broken")
        seen.add(n)
        head = objects[n][0]
        if re.search(rb"/Type\s*/Pages\b", head):
            parent = _value(head, b"Resources", objects) or parent
            left.extend((k, parent) for k in reversed(_refs(head, b"Kids", objects)))
        else:
            parts = [objects.get(k, (b"", None)) for k in _refs(head, b"Contents", objects)]
            out.append(("\n".join(_inflated(h, s or b"").decode("latin-1") for h, s in parts), _fonts(head, parent, objects)))
    if not out:
        raise Broken("no pages")
    return out


def pages(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, page, content, fonts, error) of the PDF files below path: the pages of each from 0, or one row with an error.

    path is that of input_file_name: a URI, in which a space is %20. The driver lists the files, and Spark reads some 32 small
    ones a task; where they are very many, keep them as rows of a table, for pages_of."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    name = F.input_file_name().alias("path")
    # Spark lists files without a byte but doesn't scan them; the list stays in the JVM, which holds it for the scan anyway
    jvm = spark._jvm
    listed = jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.scala.collection.mutable.ArraySeq.make(files._jdf.inputFiles()))
    all_ = DataFrame(spark._jsparkSession.createDataset(listed, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark).toDF("path")
    none = all_.join(files.select(name), "path", "left_anti")  # reads no content
    empty = none.select("path", *(F.lit(None).cast(t).alias(c) for c, t in (("page", "int"), ("content", "string"), ("fonts", "map<string,string>"))), F.lit("not a PDF").alias("error"))
    return pages_of(files.select(name, "content")).unionByName(empty)


def pages_of(files: DataFrame) -> DataFrame:
    """(path, page, content, fonts, error) of files (path, content binary), as `pages` gives it; a null or empty content isn't a PDF."""

    schema = to_arrow_schema(StructType.fromDDL(PAGES))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, held = [], 0
            for name, data in zip(*batch.columns, strict=True):
                name, data = name.as_py(), data.as_py() or b""
                try:
                    found = [(name, k, content, list(fonts.items()), None) for k, (content, fonts) in enumerate(_read(data))]
                except (Broken, zlib.error, TypeError, ValueError) as e:  # the last two of numbers that are none
                    found = [(name, None, None, None, str(e) if isinstance(e, Broken) else "broken")]
                made, held = made + found, held + len(data)
                if held > BATCH_BYTES or len(made) >= BATCH_PAGES:
                    yield _arrow(made, schema)
                    made, held = [], 0
            if made:
                yield _arrow(made, schema)

    return files.select("path", "content").mapInArrow(rows, PAGES)


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _plain(shown: Column) -> Column:
    """The text of a string in parentheses or in hexadecimal digits."""
    inner = F.regexp_replace(F.substr(shown, F.lit(2), F.length(shown) - 2), r"\r\n?", "\n")
    piece = lambda p: (
        F.when(p.rlike(r"^\\[0-7]"), F.char(F.conv(F.substr(p, F.lit(2)), 8, 10).cast("int")))
        .when(p == "\\\n", "").when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\t", "\t").when(p == "\\b", "\b").when(p == "\\f", "\f")
        .when(p.startswith("\\"), F.substr(p, F.lit(2))).otherwise(p)
    )
    literal = F.when(~inner.contains("\\"), inner).otherwise(F.array_join(F.transform(F.regexp_extract_all(inner, F.lit(r"\\[0-7]{1,3}|\\[\s\S]|[^\\]+"), 0), piece), ""))
    digits = F.regexp_replace(inner, r"\s", "")
    return F.when(shown.startswith("("), literal).otherwise(F.decode(F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)), "ISO-8859-1"))


def spans(pages: DataFrame) -> DataFrame:
    """(path, page, line, pos, text, size, bold): the texts of the pages without an error, lines from 0 as they are drawn."""
    bare = F.regexp_replace("content", r"(?s)\bBI\s.*?\sEI\b", " ")
    ops = pages.where("error is null").select("path", "page", "fonts", F.posexplode(F.regexp_extract_all(bare, F.lit(OPERATION), 0)).alias("pos", "op"))
    op, page = F.col("op"), Window.partitionBy("path", "page").orderBy("pos")  # a page
    number = lambda k: F.get(F.regexp_extract_all("op", F.lit(NUMBER), 0), F.lit(k)).try_cast("double")
    # OPERATION leaves few forms, so that both ends of an operation tell which it is
    text_first = op.startswith("(") | op.startswith("<") | op.startswith("[")
    next_line = op.endswith("'") | op.endswith('"')
    shows, begins, matrix = text_first & (op.endswith("Tj") | op.endswith("TJ") | next_line), op == "BT", ~text_first & op.endswith("Tm")
    font, moves = op.startswith("/"), ~text_first & ~op.startswith("/") & (op.endswith("Td") | op.endswith("TD"))
    breaks = begins | matrix | (op == "T*") | (shows & next_line) | (moves & (number(1) != 0))
    name = F.regexp_extract("op", r"^/(\S+)", 1)
    bold = F.coalesce(F.try_element_at("fonts", name), F.lit("")).rlike("(?i)bold|black|heavy")
    known = ops.select(
        "path", "page", "pos", F.when(shows, op).alias("op"), breaks.cast("int").alias("breaks"),
        F.when(font, F.struct(F.regexp_extract("op", rf"({NUMBER})\s+Tf$", 1).cast("double").alias("size"), bold.alias("bold"))).alias("font"),
        F.when(begins, 1.0).when(matrix, F.abs(number(3))).alias("scale"),
    )
    marked = known.select("path", "page", "pos", "op", F.sum("breaks").over(page).alias("at"), F.last("font", True).over(page).alias("font"), F.last("scale", True).over(page).alias("scale"))
    part = lambda x: F.when(x.rlike(r"^[(<]"), _plain(x)).when(x.try_cast("double") <= GAP, " ").otherwise("")
    text = F.array_join(F.transform(F.regexp_extract_all("op", F.lit(rf"{SHOWN}|{NUMBER}"), 0), part), "")
    odd = bytes(range(128, 160)).decode("cp1252", "replace")
    drawn = marked.where("op is not null").select(
        "path", "page", "at", "pos",
        F.explode_outer(F.array(F.translate(text, "".join(map(chr, range(128, 160))), odd))).alias("text"),  # a generator, so that the filter below doesn't make the text once more
        (F.coalesce("font.size", F.lit(0.0)) * F.coalesce("scale", F.lit(1.0))).alias("size"), F.coalesce("font.bold", F.lit(False)).alias("bold"),
    )
    some = drawn.where(F.length("text") > 0)
    line = F.dense_rank().over(Window.partitionBy("path", "page").orderBy("at")) - 1
    return some.select("path", "page", line.alias("line"), "pos", "text", "size", "bold")


def failures(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, error): the files that can't be read, and those without any text."""
    read = pages.where("error is null").select("path").distinct()
    empty = read.join(spans.select("path").distinct(), "path", "left_anti").select("path", F.lit("no text").alias("error"))
    return pages.where("error is not null").select("path", "error").unionAll(empty)
