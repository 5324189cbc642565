"""Document packages (zip of XML parts): files to parts to XML nodes, and back.

A file is read whole by `binaryFile` and decoded by one task, as zip needs;
everything after that is relational. Nodes carry the interval (pre, end) of
their subtree and the list of their ancestors, so that "inside of" is an
equality join on an exploded list and never compares all pairs of a part.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions.text import markup_safe, normal_path
from foliospark.sources.shared import batched, groups, ordered

#: The namespaces of document parts.
NAMESPACES = {
    "ha": "http://www.hancom.co.kr/hwpml/2011/app",
    "hc": "http://www.hancom.co.kr/hwpml/2011/core",
    "hh": "http://www.hancom.co.kr/hwpml/2011/head",
    "hp": "http://www.hancom.co.kr/hwpml/2011/paragraph",
    "hs": "http://www.hancom.co.kr/hwpml/2011/section",
    "hv": "http://www.hancom.co.kr/hwpml/2011/version",
    "hpf": "http://www.hancom.co.kr/schema/2011/hpf",
    "ocf": "urn:oasis:names:tc:opendocument:xmlns:container",
    "odf": "urn:oasis:names:tc:opendocument:xmlns:manifest:1.0",
    "opf": "http://www.idpf.org/2007/opf/",
    "c": "http://schemas.openxmlformats.org/drawingml/2006/chart",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
}
#: Fixed value: where sections lie.
SECTION = r"^Contents/section(\d+)\.xml$"
MIMETYPE = "application/hwp+zip"
XML_KINDS = ("version", "content_hpf", "header", "section", "settings", "container", "manifest", "container_rdf", "xml")


def read_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(doc, format, content): files by path; format from the content first, then the suffix, else null."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return rows.select(F.col("path").alias("doc"), sniff(F.col("content"), F.col("path")).alias("format"), "content")


def sniff(content: Column, path: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    name = F.lower(path)
    return F.when(head.startswith("504B0304"), "hwpx").when(head == "D0CF11E0A1B11AE1", "hwp").when(name.endswith(".hwpx"), "hwpx").when(name.endswith(".hwp"), "hwp")


def kind(path: Column, content: Column) -> Column:
    """Which of sixteen kinds a part is, by its path; XML parts that don't start like XML are binary."""
    xml = F.ltrim(F.decode(F.substring(content, 1, 64), "ISO-8859-1")).rlike(r"^(\xEF\xBB\xBF)?\s*<")
    checked = lambda name: F.when(xml, name).otherwise("binary_other")
    return (
        F.when(path == "mimetype", "mimetype").when(path == "version.xml", "version").when(path == "Contents/content.hpf", "content_hpf")
        .when(path == "Contents/header.xml", checked("header")).when(path.rlike(SECTION), checked("section")).when(path == "settings.xml", checked("settings"))
        .when(path == "META-INF/container.xml", "container").when(path == "META-INF/manifest.xml", "manifest").when(path == "META-INF/container.rdf", "container_rdf")
        .when(path == "Preview/PrvText.txt", "preview_text").when(path.rlike(r"^Preview/.*\.(png|jpg|jpeg|bmp|gif)$"), "preview_image")
        .when(path.startswith("BinData/"), "bindata").when(path.startswith("Scripts/"), "script").when(path.rlike(r"\.(xml|rdf|hpf)$"), "xml")
        .when(path.rlike(r"\.(txt|csv|htm|html|css|py|tsv|md)$"), "text").otherwise("binary_other")
    )


def entries(files: DataFrame) -> DataFrame:
    """(doc, entry_ord, path, content, stored, error) of every zip entry; a file that can't be read has one row with the error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(raw.as_buffer() if raw.is_valid else b"")) as z:
                        rows = [(doc, i, e.filename, z.read(e), e.compress_type == zipfile.ZIP_STORED, None) for i, e in enumerate(z.infolist()) if not e.is_dir()]
                except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, ValueError, EOFError) as e:
                    rows = [(doc, 0, None, None, None, f"{type(e).__name__}: {e}")]
                yield from rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"doc": pa.string(), "entry_ord": pa.int32(), "path": pa.string(), "content": pa.binary(), "stored": pa.bool_(), "error": pa.string()}
        yield from batched(read(batches), pa.schema(list(kinds.items())))

    return files.select("doc", "content").mapInArrow(run, "doc string, entry_ord int, path string, content binary, stored boolean, error string")


def parts(found: DataFrame) -> DataFrame:
    """(doc, entry_ord, path, kind, content, stored, copies): of equal paths the last content at the first place."""
    named = found.where(F.col("path").isNotNull()).withColumn("path", normal_path(F.col("path")))
    rows = named.groupBy("doc", "path").agg(
        F.min("entry_ord").alias("entry_ord"), F.max_by("content", "entry_ord").alias("content"), F.max_by("stored", "entry_ord").alias("stored"), F.count("*").alias("copies")
    )
    return rows.select("doc", "entry_ord", "path", kind(F.col("path"), F.col("content")).alias("kind"), "content", "stored", "copies")


NODES = "doc string, part string, pre int, end int, parent int, depth int, nth int, paragraph int, ns string, local string, text string, tail string, attrs map<string,string>, ancestors array<int>, error string"


class _Tree:
    """Rows of a part's elements in document order."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.open: list[int] = []
        self.children: list[int] = [0]
        self.last: int | None = None  # the element that text now trails
        self.paragraph: int | None = None

    def start(self, name: str, attrs: dict) -> None:
        ns, _, local = name.rpartition(" ")
        depth = len(self.open)
        nth = self.children[-1]
        self.children[-1] += 1
        self.children.append(0)
        if depth == 1 and local == "p":
            self.paragraph = 0 if self.paragraph is None else self.paragraph + 1
        inside = self.paragraph if depth > 1 or (depth == 1 and local == "p") else None
        named = {k if " " not in k else "{%s}%s" % tuple(k.rsplit(" ", 1)): v for k, v in attrs.items()}
        self.rows.append([len(self.rows), None, self.open[-1] if self.open else None, depth, nth, inside, ns or None, local, None, None, named, list(self.open)])
        self.open.append(len(self.rows) - 1)
        self.last = None

    def end(self, _: str) -> None:
        self.children.pop()
        self.last = self.open.pop()
        self.rows[self.last][1] = len(self.rows) - 1

    def data(self, text: str) -> None:
        if self.last is not None:
            self.rows[self.last][9] = (self.rows[self.last][9] or "") + text
        elif self.open:
            self.rows[self.open[-1]][8] = (self.rows[self.open[-1]][8] or "") + text


def parse(raw: bytes) -> tuple[list[list], str | None]:
    """Rows of NODES after (doc, part), and the parser's complaint if there is one. Entities aren't resolved."""
    tree = _Tree()
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = tree.start, tree.end, tree.data
    try:
        parser.Parse(raw, True)
    except expat.ExpatError as e:
        return [], str(e)
    return tree.rows, None


def nodes(rows: DataFrame) -> DataFrame:
    """Elements of the XML parts, by NODES, and `section_index`; a part that doesn't parse has one row with its error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc, part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found, error = parse(raw.as_py() or b"")
                if error is not None:
                    found = [[None] * 12]
                for r in found:
                    yield doc, part, *r[:10], list(r[10].items()) if r[10] is not None else None, r[11], error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 2 + [pa.int32()] * 6 + [pa.string()] * 4 + [pa.map_(pa.string(), pa.string()), pa.list_(pa.int32()), pa.string()]
        names = [c.split()[0] for c in re.sub(r"<[^>]*>", "", NODES).split(", ")]
        yield from batched(read(batches), pa.schema(list(zip(names, types, strict=True))))

    xml = rows.where(F.col("kind").isin(*XML_KINDS)).select("doc", F.col("path").alias("part"), "content")
    number = F.regexp_extract("part", SECTION, 1).try_cast("int")
    return xml.mapInArrow(run, NODES).withColumn("section_index", number)


def sections(rows: DataFrame) -> DataFrame:
    """(doc, path, suffix, section_index): section parts in the order of their numbers."""
    found = rows.where("kind = 'section'").select("doc", "path", F.regexp_extract("path", SECTION, 1).cast("int").alias("suffix"))
    return found.withColumn("section_index", F.row_number().over(Window.partitionBy("doc").orderBy("suffix")) - 1)


# -- writing -----------------------------------------------------------------------


def assemble(rows: DataFrame) -> DataFrame:
    """(doc, content): packages of parts in their order, the mimetype first and stored. One package, one task."""

    def pack(found: list[tuple]) -> tuple:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for _, path, content in found:
                # A fixed date: equal parts give equal packages.
                z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_STORED if path == "mimetype" else zipfile.ZIP_DEFLATED)
        return found[0][0], out.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = (b.select(["doc", "path", "content"]) for b in batches)
        yield from batched(map(pack, groups(cut, 1)), pa.schema([("doc", pa.string()), ("content", pa.binary())]))

    found = rows.select("doc", "entry_ord", "path", "content")
    return ordered(found, ["doc"], F.col("path") != "mimetype", "entry_ord", "path").mapInArrow(run, "doc string, content binary")


def serialize(tree: DataFrame) -> DataFrame:
    """(doc, path, content): XML of parts from their nodes. Namespaces get the prefixes of NAMESPACES, or ns0, ns1, ..."""

    def write(found: list[tuple]) -> tuple:
        from xml.sax.saxutils import escape, quoteattr

        spaces = {v: k for k, v in NAMESPACES.items()}
        used: dict[str, str] = {}

        def name(ns, local):
            if ns is None:
                return local
            used.setdefault(ns, spaces.get(ns, f"ns{len(used)}"))
            return f"{used[ns]}:{local}"

        out: list[str] = []
        stack: list[tuple[int, str, str | None]] = []
        head = None

        def close():
            _, tag, tail = stack.pop()
            out.append(f"</{tag}>" + escape(markup_safe(tail or "")))

        for _, _, pre, end, ns, local, inner, tail, attrs in found:
            while stack and stack[-1][0] < pre:
                close()
            tag = name(ns, local)
            attrs = dict(attrs or ())
            text = "".join(f" {name(*m.groups()) if (m := re.match(r'{(.*)}(.*)', k)) else k}={quoteattr(markup_safe(v))}" for k, v in attrs.items())
            if head is None:
                head = len(out)
            out.append(f"<{tag}{text}>" + escape(markup_safe(inner or "")))
            stack.append((end, tag, tail))
        while stack:
            close()
        if head is not None:
            out[head] = re.sub(r"^(<[^\s>]+)", lambda m: m[1] + "".join(f' xmlns:{p}="{u}"' for u, p in used.items()), out[head])
        xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + "".join(out)
        return *found[0][:2], xml.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(map(write, groups(batches, 2)), pa.schema([("doc", pa.string()), ("path", pa.string()), ("content", pa.binary())]))

    found = tree.where("pre is not null").select("doc", "part", "pre", "end", "ns", "local", "text", "tail", "attrs")
    return ordered(found, ["doc", "part"], "pre").mapInArrow(run, "doc string, path string, content binary")


def tree_digests(tree: DataFrame) -> DataFrame:
    """(doc, part, n, digest): the nodes of each part as one digest: their order, names, texts and attributes."""
    facts = F.sha2(F.to_json(F.struct("pre", "end", "ns", "local", "text", "tail", F.array_sort(F.map_entries("attrs")).alias("attrs"))), 256)
    # Sums of four pieces of the nodes' own digests, so that nothing is gathered.
    pieces = [F.sum(F.conv(F.substring(facts, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"d{i}") for i in range(4)]
    rows = tree.where("pre is not null").groupBy("doc", "part").agg(F.count("*").alias("n"), *pieces)
    return rows.select("doc", "part", "n", F.concat_ws("-", *[F.col(f"d{i}").cast("string") for i in range(4)]).alias("digest"))


def with_changed(rows: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Parts with the content of those whose nodes changed written anew; all others keep their bytes.

    `before` and `after` are the nodes of `rows` and those nodes edited. A part
    that is only in `after` comes last in its package; one that is only in
    `before` goes.
    """
    was, now = tree_digests(before).withColumnRenamed("digest", "was"), tree_digests(after).withColumnRenamed("digest", "now")
    both = was.join(now.drop("n"), ["doc", "part"], "full_outer")
    changed = both.where("now is not null and not was <=> now").select("doc", "part")
    gone = both.where("now is null").select("doc", F.col("part").alias("path"))
    new = serialize(after.join(changed, ["doc", "part"], "left_semi"))
    last = rows.groupBy("doc").agg(F.max("entry_ord").alias("_last"))
    added = new.join(rows.select("doc", "path"), ["doc", "path"], "left_anti").join(last, "doc", "left")
    order = F.row_number().over(Window.partitionBy("doc").orderBy("path"))
    added = added.select("doc", (F.coalesce("_last", F.lit(-1)) + order).cast("int").alias("entry_ord"), "path", kind(F.col("path"), F.col("content")).alias("kind"), "content", F.lit(False).alias("stored"), F.lit(1).cast("long").alias("copies"))
    kept = rows.join(gone, ["doc", "path"], "left_anti").join(new.withColumnRenamed("content", "_new"), ["doc", "path"], "left")
    return kept.withColumn("content", F.coalesce("_new", "content")).select("doc", "entry_ord", "path", "kind", "content", "stored", "copies").unionByName(added)


def save(packages: DataFrame, folder: str, suffix: str = ".hwpx") -> DataFrame:
    """Write each package as a file below `folder` (any file system that Arrow knows); (doc, path) of what was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        for batch in batches:
            store, base = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
            store.create_dir(base, recursive=True)
            written = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = re.sub(r"[^\w.-]+", "_", doc.rsplit("/", 1)[-1]).removesuffix(suffix) + suffix
                with store.open_output_stream(f"{base}/{name}") as out:
                    out.write(raw.as_buffer())
                written.append(f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(written, pa.string())], ["doc", "path"])

    return packages.select("doc", "content").mapInArrow(run, "doc string, path string")
