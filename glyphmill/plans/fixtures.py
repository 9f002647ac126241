"""Small inputs that the tables lack: Word files, pixels, sound, mail, signed claims; the same at every call."""

from __future__ import annotations

import io
import json
import wave
import zipfile
from xml.sax.saxutils import escape

import numpy as np
from pyspark.sql import DataFrame, SparkSession

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"'


def run(text: str, rsid: str | None = None, props: str = "", kind: str = "t") -> str:
    r = f' w:rsidR="{rsid}"' if rsid else ""
    p = f"<w:rPr>{props}</w:rPr>" if props else ""
    return f'<w:r{r}>{p}<w:{kind} xml:space="preserve">{escape(text)}</w:{kind}></w:r>'


def paragraph(*runs: str, para: str = "00000001", rsid: str = "00AA0001") -> str:
    return f'<w:p w14:paraId="{para}" w:rsidR="{rsid}">{"".join(runs)}</w:p>'


def body(*paragraphs: str) -> str:
    return f'<?xml version="1.0"?><w:document {NS}><w:body>{"".join(paragraphs)}</w:body></w:document>'


def docx(document: str, core: dict | None = None, app: dict | None = None, settings: str = "", parts: dict | None = None, when=(1980, 1, 1, 0, 0, 0), spread: bool = False) -> bytes:
    """A package of eight parts and more; with `spread` each part has a time of its own."""
    c = "".join(f"<dc:{k}>{escape(str(v))}</dc:{k}>" for k, v in (core or {}).items())
    a = "".join(f"<{k}>{escape(str(v))}</{k}>" for k, v in (app or {}).items())
    files = {
        "[Content_Types].xml": "<Types/>", "_rels/.rels": "<Relationships/>", "word/document.xml": document, "word/settings.xml": f"<w:settings {NS}>{settings}</w:settings>",
        "word/styles.xml": "<styles/>", "word/_rels/document.xml.rels": "<Relationships/>", "docProps/core.xml": f'<cp:coreProperties xmlns:cp="c" xmlns:dc="d">{c}</cp:coreProperties>', "docProps/app.xml": f"<Properties>{a}</Properties>",
        **(parts or {}),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, (name, text) in enumerate(files.items()):
            at = (*when[:4], (when[4] + k) % 60, when[5]) if spread else when
            z.writestr(zipfile.ZipInfo(name, at), text)
    return out.getvalue()


SENTENCE = "The committee reviewed the proposal and the members discussed the results of the second survey in detail. "


def word_files() -> list[tuple[str, bytes]]:
    """A file put together by a program, an ordinary one with edits, one with an odd run, and two that are refused."""
    long = [paragraph(run(SENTENCE * 6, "00AA0001"), para=f"{k:08X}") for k in range(4)]
    edited = paragraph(run("The first words stay as they were written ", "00AA0001"), run("inserted words", "00BB0002", '<w:lang w:val="en-GB"/>'), run(" and the last words stay too for all of it", "00AA0001"))
    tracked = paragraph(run("Before ", "00AA0001"), f'<w:ins w:author="A" w:date="2024-01-02T00:00:00Z">{run("added text", "00CC0003")}</w:ins>', f'<w:del w:author="B" w:date="2024-01-03T00:00:00Z">{run("removed", "00CC0003", kind="delText")}</w:del>', run(" after", "00AA0001"))
    hidden = paragraph(run("Seen. ", "00AA0001"), run("Not seen.", "00AA0001", "<w:vanish/>"))
    sessions = "".join(f'<w:rsid w:val="00AA{k:04X}"/>' for k in range(12))
    stamp = "2024-01-01T10:00:00Z"
    return [
        ("made", docx(body(*long), {"creator": "x", "created": stamp, "modified": stamp, "revision": 1}, {"Words": 4000, "Pages": 1, "TotalTime": 0, "Application": "Word"}, sessions)),
        ("ordinary", docx(body(*long[:2], edited, tracked, hidden), {"creator": "A", "created": stamp, "modified": "2024-02-01T10:00:00Z", "revision": 9}, {"Words": 400, "Pages": 2, "TotalTime": 95}, "<w:trackRevisions/>", when=(2024, 2, 1, 10, 0, 0), spread=True)),
        ("linked", docx(body(edited), parts={"word/vbaProject.bin": "x", "word/_rels/a.rels": '<R Target="file:///C:/me" TargetMode="External"/><R Target="https://x.org" TargetMode="External"/>', "word/comments.xml": f'<w:comments {NS}><w:comment w:author="C"/></w:comments>', "word/header1.xml": body(paragraph(run("Head line of the file")))})),
        ("entities", docx('<!DOCTYPE x [<!ENTITY a "b">]><w:document/>')),
        ("broken", b"PK\x03\x04 no package"),
        ("climbs", docx(body(edited), parts={"../evil.xml": "<x/>"})),
    ]


def assets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(word_files(), "asset_id string, content binary")


def pixels() -> list[tuple[str, np.ndarray]]:
    r = np.random.default_rng(7)
    y, x = np.mgrid[0:96, 0:128]
    smooth = np.stack([x * 1.5, y * 2.0, (x + y) * 0.9], -1)
    noisy = np.clip(smooth + r.normal(0, 12, smooth.shape), 0, 255)
    patched = noisy.copy()
    patched[32:64, 64:96] = 128 + 60 * np.sin(x[32:64, 64:96, None] / 2)
    copied = np.clip(r.normal(128, 40, smooth.shape), 0, 255)
    copied[64:80, 96:112] = copied[:16, :16]
    return [(n, np.clip(a, 0, 255).astype(np.uint8)) for n, a in (("smooth", smooth), ("noisy", noisy), ("patched", patched), ("copied", copied))]


def images(spark: SparkSession) -> DataFrame:
    rows = [(n, a.tobytes(), (a @ [0.299, 0.587, 0.114]).astype(np.uint8).tobytes(), a.shape[1], a.shape[0]) for n, a in pixels()]
    return spark.createDataFrame(rows, "asset_id string, rgb binary, gray binary, width int, height int")


def sound(spark: SparkSession) -> DataFrame:
    t = np.arange(16_000 * 4) / 16_000
    waves = {"tone": np.sin(2 * np.pi * 440 * t) * 0.5, "loud": np.clip(np.sin(2 * np.pi * 50 * t) * 3, -1, 1), "noise": np.random.default_rng(1).normal(0, 0.1, len(t))}
    rows = []
    for name, x in waves.items():
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(2)
            f.setframerate(16_000)
            f.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
        rows.append((name, out.getvalue()))
    return spark.createDataFrame([*rows, ("text", b"no sound")], "asset_id string, content binary")


JPEG = b"\xff\xd8" + b"\xff\xe1\x00\x08Exif\x00\x00" + b"\xff\xed\x00\x06abcd" + b"\xff\xfe\x00\x0amidjourn" + b"\xff\xda\x00\x04\x00\x00data\xff\xd9" + b"tail"


def png(*chunks: tuple[bytes, bytes], tail: bytes = b"") -> bytes:
    return b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + k + d + bytes(4) for k, d in chunks) + tail


def containers(spark: SparkSession) -> DataFrame:
    rows = [("a.jpg", JPEG), ("b.png", png((b"IHDR", bytes(13)), (b"tEXt", b"Software\0Stable Diffusion"), (b"IEND", b""))), ("c.png", png((b"IHDR", bytes(13)), (b"IEND", b""), tail=b"more")), ("d.txt", b"text")]
    return spark.createDataFrame([(n, n, c) for n, c in rows], "asset_id string, name string, content binary")


def office_files() -> list[tuple[str, bytes]]:
    """A file with eight media parts, of which the third is no image, one with none, and one that is refused."""
    pictures = {f"word/media/image{k}.png": png((b"IHDR", bytes(13)), (b"IEND", b""), tail=b"x" * (k == 2)).decode("latin-1") for k in range(8) if k != 2}
    files = {"word/media/image0.jpg": JPEG.decode("latin-1"), "word/media/deep/no.png": "x", "word/media/sound.wav": "x", **pictures}
    return [("media", package(files)), ("plain", docx(body(paragraph(run("text"))))), ("climbs", package({"../word/media/a.png": "x"}))]


def package(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text.encode("latin-1"))
    return out.getvalue()


MAIL = b"From: a@example.com\r\nSubject: one\r\n two\r\nsubject: last\r\nX-Long: v\r\n\tw\r\n\r\nBody line\r\n\r\nmore"


def mail(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("m", MAIL), ("n", b"To: b@example.com\n\nhi"), ("o", b"no headers")], "asset_id string, content binary")


def stores(spark: SparkSession) -> DataFrame:
    def store(state, source, active="m", status=None, label="c2pa.actions"):
        return json.dumps({"active_manifest": active, "validation_state": state, "validation_status": status or [], "manifests": {"m": {"title": "t", "assertions": [{"label": label, "data": {"actions": [{"digitalSourceType": source}]}}]}}})

    ai, camera = "http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia", "http://cv.iptc.org/newscodes/digitalsourcetype/digitalCapture"
    rows = [("trusted", store("Trusted", ai)), ("valid", store("Valid", ai)), ("camera", store("Trusted", camera)), ("failed", store("Trusted", ai, status=[{"code": "x"}])), ("inactive", store("Trusted", ai, active="other")), ("v2", store("Trusted", ai, label="c2pa.actions.v2")), ("none", "{}"), ("bad", "no json")]
    return spark.createDataFrame(rows, "asset_id string, store string")


def cohort_model() -> dict:
    names = [f"f{i}" for i in range(111)]
    return {"version": "hebrew-cohort-logistic-v1", "features": names, "window": 350, "function_words": ["של", "על", "את"] + [f"מ{i}" for i in range(51)], "phrases": ["של על"] + [f"ז{i}" for i in range(19)], "prefixes": ["ה", "ו"] + [f"ק{i}" for i in range(18)], "mean": [0.0] * 111, "scale": [1.0] * 111, "coefficients": [0.0] * 110 + [0.5], "intercept": 0.0, "threshold": 0.5, "train_source_ids": ["0" * 36], "report": {"training_performed": True, "is_generic_ai_accuracy": False}}


def hebrew(spark: SparkSession) -> DataFrame:
    words = ["שלום", "עולם", "של", "על", "הבית", "וילד", "ספר", "כתב"]
    plain = " ".join(words[(i * i + i // 3) % 8] for i in range(620))
    marked = " ".join("שָלוֹם" for _ in range(600))
    return spark.createDataFrame([(1, plain), (2, marked), (3, "שלום עולם"), (4, "english only")], "doc_id long, text string")
