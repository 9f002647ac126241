"""Office packages as tables: parts, paragraphs, runs, revisions, properties.

A package is opened once, in ``parts``; all else reads its rows.  A package that
breaks a limit or a rule of admission is one row of status and no part.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T

MOST_PARTS, MOST_BYTES, MOST_XML = 2048, 32 << 20, 8 << 20
PARTS = "asset_id string, status string, name string, bytes long, zip_time timestamp, dos_epoch boolean, xml string"
PARAGRAPHS = "asset_id string, part string, part_ord int, index int, para_id string, text string, inserted int, deleted int, hidden int"
RUNS = "asset_id string, paragraph int, run int, text string, para_id string, paragraph_rsid string, run_rsid string, bold boolean, italic boolean, lang string, no_proof boolean, style string, inserted boolean, deleted boolean"

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
_DTD = re.compile(r"<!DOCTYPE|<!ENTITY", re.I)


def admission(z: zipfile.ZipFile) -> str:
    """ok, or the rule that a package breaks."""
    infos = z.infolist()
    names = [i.filename for i in infos]
    if len(infos) > MOST_PARTS:
        return "too_many_parts"
    if sum(i.file_size for i in infos) > MOST_BYTES:
        return "too_large"
    if any(i.filename.endswith((".xml", ".rels")) and i.file_size > MOST_XML for i in infos):
        return "part_too_large"
    if any(".." in n.split("/") or n.startswith(("/", "\\")) for n in names):
        return "unsafe_name"
    if len(set(names)) != len(names):
        return "duplicate_part"
    if any(i.flag_bits & 1 for i in infos):
        return "encrypted"
    return "ok"


def decoded(raw: bytes) -> str:
    """XML bytes by their byte order mark; UTF-8 without one."""
    for mark, name in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    return raw.decode("utf-8", "replace")


def _open(batches):
    for frame in batches:
        rows = []
        for asset, content in zip(frame["asset_id"], frame["content"]):
            try:
                z = zipfile.ZipFile(io.BytesIO(content))
            except (zipfile.BadZipFile, TypeError, ValueError, NotImplementedError):
                rows.append((asset, "not_a_package", None, None, None, None, None))
                continue
            status = admission(z)
            if status != "ok":
                rows.append((asset, status, None, None, None, None, None))
                continue
            for i in z.infolist():
                text = decoded(z.read(i)) if i.filename.lower().endswith((".xml", ".rels")) else None
                if text is not None and _DTD.search(text):
                    text = None
                y, mo, d, h, mi, s = i.date_time
                when = pd.Timestamp(max(y, 1980), max(1, min(mo, 12)), max(1, min(d, 28 if mo == 2 else 30)), min(h, 23), min(mi, 59), min(s, 59))
                rows.append((asset, "ok", i.filename, i.file_size, when, i.date_time == (1980, 1, 1, 0, 0, 0), text))
        yield pd.DataFrame(rows, columns=["asset_id", "status", "name", "bytes", "zip_time", "dos_epoch", "xml"])


def parts(assets: DataFrame) -> DataFrame:
    """A row a part, from (asset_id, content); parts with a DTD keep their row without text."""
    return assets.select(F.col("asset_id").cast("string").alias("asset_id"), "content").mapInPandas(_open, PARTS)


MEDIA = "asset_id string, position int, name string, content binary"
_MEDIA_NAME = re.compile(r"(?:word|ppt|xl)/media/[^/]+$", re.I)
MOST_MEDIA = 6


def _embedded(batches):
    for frame in batches:
        rows = []
        for asset, content in zip(frame["asset_id"], frame["content"]):
            try:
                z = zipfile.ZipFile(io.BytesIO(content))
            except (zipfile.BadZipFile, TypeError, ValueError, NotImplementedError):
                continue
            if admission(z) == "ok":
                names = [i for i in z.infolist() if _MEDIA_NAME.search(i.filename)]
                rows += [(asset, k, i.filename, z.read(i)) for k, i in enumerate(names[:MOST_MEDIA])]
        yield pd.DataFrame(rows, columns=["asset_id", "position", "name", "content"])


def embedded_media(assets: DataFrame) -> DataFrame:
    """A row for each of a package's first six media parts, in its order; refused packages have none."""
    return assets.select(F.col("asset_id").cast("string").alias("asset_id"), "content").mapInPandas(_embedded, MEDIA)


def _root(xml: str):
    try:
        return ET.fromstring(xml) if xml else None
    except ET.ParseError:
        return None


def _part_order(name: str) -> int:
    for k, start in enumerate(("word/document", "word/header", "word/footer", "word/footnotes", "word/endnotes")):
        if name.startswith(start):
            return k
    return 9


def _hidden(run) -> bool:
    p = run.find(f"{W}rPr")
    v = None if p is None else p.find(f"{W}vanish")
    return v is not None and v.get(f"{W}val", "true") not in ("0", "false")


def paragraph_list(xml: str) -> list[tuple]:
    """(para_id, text, inserted, deleted, hidden) of a part's paragraphs: text as read, without deleted or hidden runs."""
    root = _root(xml)
    out = []
    for p in root.iter(f"{W}p") if root is not None else ():
        gone = {id(r) for d in p.iter() if d.tag in (f"{W}del", f"{W}moveFrom") for r in d.iter(f"{W}r")}
        text, hidden = [], 0
        for r in p.iter(f"{W}r"):
            if _hidden(r):
                hidden += 1
                continue
            if id(r) in gone:
                continue
            for n in r:
                if n.tag == f"{W}t":
                    text.append(n.text or "")
                elif n.tag == f"{W}tab":
                    text.append("\t")
                elif n.tag in (f"{W}br", f"{W}cr"):
                    text.append("\n")
        out.append((p.get(f"{W14}paraId"), "".join(text), sum(1 for _ in p.iter(f"{W}ins")), sum(1 for _ in p.iter(f"{W}del")), hidden))
    return out


def _paragraphs(batches):
    for frame in batches:
        rows = [(a, n, _part_order(n), k, *p) for a, n, x in zip(frame["asset_id"], frame["name"], frame["xml"]) for k, p in enumerate(paragraph_list(x))]
        yield pd.DataFrame(rows, columns=["asset_id", "part", "part_ord", "index", "para_id", "text", "inserted", "deleted", "hidden"])


def paragraphs(part_rows: DataFrame) -> DataFrame:
    """A row a paragraph of the text parts: body, headers, footers, notes."""
    wanted = part_rows.where(F.col("name").rlike(r"^word/(document|header[0-9]*|footer[0-9]*|footnotes|endnotes)\.xml$") & F.col("xml").isNotNull())
    return wanted.select("asset_id", "name", "xml").mapInPandas(_paragraphs, PARAGRAPHS)


def documents(paragraph_table: DataFrame) -> DataFrame:
    """asset_id, text: the paragraphs in order, joined by an empty line."""
    order = F.array_sort(F.collect_list(F.struct("part_ord", "part", "index", "text")))
    return paragraph_table.groupBy("asset_id").agg(F.array_join(F.transform(order, lambda x: x["text"]), "\n\n").alias("text"))


def run_list(xml: str) -> list[tuple]:
    """Runs with text of the body, with what of their properties tells one editing session from another."""
    root = _root(xml)
    out = []
    for k, p in enumerate(root.iter(f"{W}p") if root is not None else ()):
        marks = {}
        for d in p.iter():
            if d.tag in (f"{W}ins", f"{W}del"):
                for r in d.iter(f"{W}r"):
                    marks.setdefault(id(r), set()).add(d.tag)
        n = 0
        for r in p.iter(f"{W}r"):
            text = "".join((x.text or "") if x.tag in (f"{W}t", f"{W}delText") else "\t" if x.tag == f"{W}tab" else "\n" if x.tag == f"{W}br" else "" for x in r)
            if not text:
                continue
            props = r.find(f"{W}rPr")
            has = lambda t: props is not None and props.find(f"{W}{t}") is not None
            val = lambda t, a="val": (props.find(f"{W}{t}").get(f"{W}{a}") or "true") if has(t) else None
            fields = [has("b"), has("i"), val("u"), has("strike"), val("sz"), val("color"), val("rFonts", "ascii"), val("lang"), has("rtl"), has("noProof"), has("vanish")]
            own = marks.get(id(r), set())
            out.append((k, n, text, p.get(f"{W14}paraId"), p.get(f"{W}rsidR"), r.get(f"{W}rsidR"), fields[0], fields[1], fields[7], fields[9], "|".join(map(str, fields)), f"{W}ins" in own, f"{W}del" in own))
            n += 1
    return out


def _runs(batches):
    for frame in batches:
        rows = [(a, *r) for a, x in zip(frame["asset_id"], frame["xml"]) for r in run_list(x)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RUNS.split(", ")])


def runs(part_rows: DataFrame) -> DataFrame:
    """A row a run of the body."""
    return part_rows.where(F.col("name") == "word/document.xml").select("asset_id", "xml").mapInPandas(_runs, RUNS)


def properties(part_rows: DataFrame) -> DataFrame:
    """A row an asset: core and application properties, and whether a core one is ambiguous."""
    core, app = (F.coalesce(F.max(F.when(F.col("name") == n, F.col("xml"))), F.lit("")) for n in ("docProps/core.xml", "docProps/app.xml"))
    one = part_rows.groupBy("asset_id").agg(core.alias("core"), app.alias("app"))
    tags = {k: T.tag_text(F.col("core"), k) for k in ("creator", "lastModifiedBy", "created", "modified", "revision", "title")}
    counts = {k: T.tag_text(F.col("app"), k) for k in ("Application", "Words", "Pages", "TotalTime")}
    twice = F.regexp_count("core", F.lit(r"<(?:[a-z]+:)?creator[ >]")) > 1
    return one.select("asset_id", *(v.alias(k) for k, v in {**tags, **counts}.items()), twice.alias("ambiguous_creator"))


def _joined(part_rows: DataFrame) -> DataFrame:
    at = lambda n: F.coalesce(F.max(F.when(F.col("name") == n, F.col("xml"))), F.lit(""))
    rels = F.array_join(F.collect_list(F.when(F.col("name").endswith(".rels"), F.col("xml"))), "\n")
    like = lambda p: F.count_if(F.lower("name").rlike(p))
    return part_rows.where("status = 'ok'").groupBy("asset_id").agg(
        at("word/document.xml").alias("document"), at("word/settings.xml").alias("settings"), at("word/comments.xml").alias("comments"), rels.alias("rels"),
        F.count("*").alias("entries"), F.count_distinct("zip_time").alias("zip_times"), F.min("zip_time").alias("zip_earliest"), F.max("zip_time").alias("zip_latest"), F.bool_and("dos_epoch").alias("all_dos_epoch"),
        like(r"(comments|threadedcomments)[0-9]*\.xml$").alias("comment_parts"), like("(embeddings|oleobject|media)/").alias("embedded"), like(r"vbaproject\.bin$").alias("macros"), like("^customxml/").alias("custom_xml"), like(r"people\.xml$").alias("people"), like("_xmlsignatures/").alias("signatures"),
    )


def _sessions(xml: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(T.found(xml, pattern, 1), F.upper))


def structure(part_rows: DataFrame) -> DataFrame:
    """A row an asset: counts of parts, revisions, sessions, external targets and leaked local paths."""
    j = _joined(part_rows)
    doc, rels = F.col("document"), F.col("rels")
    targets = F.array_union(T.found(rels, r'(?i)Target="([^"]+)"[^>]*TargetMode="External"', 1), T.found(rels, r'(?i)TargetMode="External"[^>]*Target="([^"]+)"', 1))
    leaks = F.filter(targets, lambda x: x.rlike(r"(?i)^(?:file:|[A-Za-z]:\\|\\\\)"))
    n = lambda t: T.occurrences(doc, rf"<w:{t}[ />]")
    return j.select(
        "asset_id", "entries", "zip_times", "zip_earliest", "zip_latest", "all_dos_epoch", "comment_parts", "embedded", "macros", "custom_xml", "people", "signatures",
        n("ins").alias("insertions"), n("del").alias("deletions"), (n("moveFrom") + n("moveTo")).alias("moves"),
        _sessions(doc, r'w:rsid(?:R|RPr|Del|P|Sect)="([0-9A-Fa-f]+)"').alias("used_sessions"), _sessions(F.col("settings"), r'<w:rsid\s+w:val="([0-9A-Fa-f]+)"\s*/>').alias("declared_sessions"),
        F.size(targets).cast("long").alias("external_targets"), F.slice(targets, 1, 30).alias("external_sample"), F.size(leaks).cast("long").alias("local_paths"),
        F.array_distinct(T.found(F.col("comments"), r'w:author="([^"]+)"', 1)).alias("comment_authors"), F.array_distinct(T.found(doc, r'w:author="([^"]+)"', 1)).alias("revision_authors"),
        F.size(F.array_distinct(T.found(doc, r'w14:paraId="([0-9A-Fa-f]+)"', 1))).alias("paragraph_ids"), F.col("settings").rlike("<w:trackRevisions[ />]").alias("tracking"),
        F.col("settings").rlike("<w:removePersonalInformation[ />]").alias("strips_persons"), F.col("settings").rlike("<w:removeDateAndTime[ />]").alias("strips_times"),
    )


def revisions(part_rows: DataFrame, most: int = 500) -> DataFrame:
    """A row a tracked change: asset_id, pos, type, author, date; `most` at most for an asset."""
    doc = part_rows.where(F.col("name") == "word/document.xml")
    marks = F.slice(T.found(F.col("xml"), r"<w:(?:ins|del|moveFrom|moveTo)[ >][^>]*>?"), 1, most)
    at = lambda p: F.nullif(F.regexp_extract("mark", p, 1), F.lit(""))
    return doc.select("asset_id", F.posexplode(marks).alias("pos", "mark")).select("asset_id", "pos", at("<w:([A-Za-z]+)").alias("type"), at('w:author="([^"]*)"').alias("author"), at('w:date="([^"]*)"').alias("date"))


def office_text(part_rows: DataFrame) -> DataFrame:
    """asset_id, text of slides, sheets and documents, by the kind of their parts."""
    kinds = (
        (r"^word/(document|header[0-9]*|footer[0-9]*|footnotes|endnotes|comments)\.xml$", r"(?s)<w:(?:t|delText)(?:\s[^>]*)?>(.*?)</w:(?:t|delText)>"),
        (r"^ppt/slides/slide[0-9]+\.xml$", r"(?s)<a:t(?:\s[^>]*)?>(.*?)</a:t>"),
        (r"^xl/sharedStrings\.xml$", r"(?s)<t(?:\s[^>]*)?>(.*?)</t>"),
    )
    pieces = F.array().cast("array<string>")
    for name, pattern in kinds:
        pieces = F.when(F.col("name").rlike("(?i)" + name), T.found(F.col("xml"), pattern, 1)).otherwise(pieces)
    rows = part_rows.where(F.col("xml").isNotNull()).select("asset_id", "name", F.array_join(pieces, " ").alias("t")).where("t <> ''")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "t"))), lambda x: x["t"]), " ")
    return rows.groupBy("asset_id").agg(T.entities_decoded(T.trimmed(F.regexp_replace(whole, r"\s+", " "))).alias("text"))
