"""What single operators must give on small inputs."""

from __future__ import annotations

import gzip
import hmac
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import metrics as M
from glyphmill.functions import text as T
from glyphmill.operators import cohort, context, evidence, fusion, matching, process, records, training
from glyphmill.plans import fixtures as X
from glyphmill.sources import files, media, ooxml


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


# --- text --------------------------------------------------------------------


def test_words_keep_marks_and_inner_signs(spark):
    assert one(spark, "שָלוֹם don't well-known x_y", T.words) == ["שָלוֹם", "don't", "well-known", "x", "y"]


@pytest.mark.parametrize(("text", "code"), [("שלום abc", "he"), ("漢字かな", "ja"), ("漢字", "zh"), ("", "und"), ("123", "und"), ("привет a", "cyrl"), ("ab שש", "he"), ("مرحبا", "ar")])
def test_script_language(spark, text, code):
    assert one(spark, text, lambda t: T.script_language(T.script_counts(t))) == code


def test_hebrew_phrases_count_by_unicode_edges_but_never_in_the_panel(spark):
    text = "בנוסף לכך, בנוסף. ובנוסף"
    assert one(spark, text, lambda t: T.discourse_count(t, F.lit("he"))) == 2
    assert one(spark, text, lambda t: T.ascii_discourse_count(t, T.panel_language(t))) == 0
    assert one(spark, "Overall, overalls overall", lambda t: T.ascii_discourse_count(t, F.lit("en"))) == 2


def test_places_of_lines_count_code_points_and_utf16_units(spark):
    text = "a\U0001f600b\r\n\nשָ\nend"
    rows = evidence.paragraph_rows(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    raw = text.encode("utf-16-le")
    assert [r.text for r in rows] == ["a\U0001f600b", "שָ", "end"]
    for r in rows:
        assert text[r.start_cp : r.end_cp] == r.text
        assert raw[2 * r.start_utf16 : 2 * r.end_utf16].decode("utf-16-le") == r.text


def test_metrics_against_plain_python(spark):
    text = "One two three. One two four! Is it so? " * 7 + "A rare word ends it."
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = M.with_panels(M.measured(d)).first()
    w = re.findall(r"[^\W_]+(?:['’\-][^\W_]+)*", text.lower())
    s = [x for x in re.split(r"(?<=[.!?])\s+", text) if x]
    lens = [len(x.split()) for x in s]
    n = Counter(w)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    starts = [tuple(x.lower().split()[:3]) for x in s]
    assert (r.words, r.sentences) == (len(w), len(s))
    assert r.sentence_cv == pytest.approx(np.std(lens) / np.mean(lens))
    assert r.ttr == pytest.approx(len(n) / len(w))
    assert r.entropy == pytest.approx(-sum(c / len(w) * math.log2(c / len(w)) for c in n.values()))
    assert r.repeat3 == pytest.approx(1 - len(set(grams)) / len(grams))
    assert r.starters == pytest.approx(1 - len({tuple(t.strip(".!?") for t in x) for x in starts}) / len(starts))
    assert r.compression == pytest.approx(len(gzip.compress(text.encode(), 9, mtime=0)) / len(text))


def test_an_empty_text_has_the_points_of_its_zeros(spark):
    r = M.with_panels(M.measured(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string"))).collect()
    assert {(x.predictability, x.rhythm, x.lexical, x.ai_residue, x.local_score) for x in r} == {(71, 0, 0, 0, 15)}


# --- evidence ----------------------------------------------------------------


def status(spark, text):
    return evidence.verdicts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().status


@pytest.mark.parametrize(
    ("text", "want"),
    [("I used ChatGPT here.", "self_reported"), ('He said "I used ChatGPT".', "not_assessed"), ("I never used it; we used AI", "not_assessed"), ("The study: we used AI", "not_assessed"), ("נעזרתי בכלי בינה מלאכותית", "self_reported"), ("as an AI language model", "content_signal"), ("plain", "not_assessed"), ("", "not_assessed")],
)
def test_disclosures_and_their_guards(spark, text, want):
    assert status(spark, text) == want


def test_every_finding_is_where_it_says(spark):
    text = "\U0001f600 פתיח\nxx I used AI and I used Claude\n" + "line\n" * 3000 + "as an ai language model"
    rows = evidence.findings(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(rows) == 3
    assert all(text[r.start : r.end] == r.quote for r in rows)


def test_long_texts_and_texts_of_many_lines_are_inspected(spark):
    long = "word " * 400_000 + "\nas an ai language model"
    many = "line\n" * 30_000 + "I used Claude"
    d = spark.createDataFrame([(1, long), (2, many), (3, "x" * 1_200_000)], "doc_id long, text string")
    assert {r.doc_id: r.verdict for r in evidence.verdicts(d).collect()} == {1: "AI_RESIDUE_FOUND", 2: "AI_USE_DISCLOSED", 3: "CLASSIFIER_NOT_CONFIGURED"}
    places = {r.doc_id: (r.paragraph, r.start) for r in evidence.findings(d).collect()}
    assert places == {1: (1, 2_000_001), 2: (30_000, 150_000)}
    rows = evidence.paragraph_rows(d.where("doc_id = 2")).collect()
    assert [(r["index"], r.start_cp, r.start_utf16) for r in rows] == [(k, 5 * k, 5 * k) for k in range(30_001)]


def test_surroundings_of_findings(spark):
    short, long = "I used Claude. " + "x" * 300, "a" * 200 + " I used Claude " + "b" * 400
    rows = evidence.findings(spark.createDataFrame([(1, f"{short}\n{long}")], "doc_id long, text string")).orderBy("paragraph").collect()
    assert [r.context for r in rows] == [short, long[101 : 201 + 13 + 150]]


def test_section_of_a_disclosure_counts_the_line_below_once(spark):
    text = "הצהרה על שימוש בכלי בינה מלאכותית\nהשימוש נעשה להגהה\nלא נעשה השימוש נעשה\nהשתמשתי בעט\nהשתמשתי שוב"
    rows = evidence.findings(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sorted(r.paragraph for r in rows) == [1, 3]


def test_process_settles_a_verdict_only_where_the_text_says_nothing(spark):
    d = spark.createDataFrame([("not_assessed", "strong_assembly_signal"), ("self_reported", "strong_assembly_signal"), ("not_assessed", "assembly_review")], "status string, process_status string").withColumn("verdict", F.lit("x"))
    assert [r.verdict for r in evidence.with_process_verdict(d).collect()] == ["STRONG_FILE_ASSEMBLY_SIGNAL", "x", "FILE_ASSEMBLY_REVIEW"]


# --- context -----------------------------------------------------------------

ACADEMIC = "תוכן עניינים\nמבוא ....... 3\nשיטה 5\nגוף הטקסט מתחיל כאן.\nעוד גוף.\nמקורות\nכהן א. (2001). ספר.\nלוי ב. (2002). ספר.\n1. פרק נוסף\nגוף אחרון."


def test_contents_and_references_are_set_apart_and_length_stays(spark):
    d = spark.createDataFrame([(1, ACADEMIC)], "doc_id long, text string")
    rules = [r.rule for r in context.classified_lines(d).orderBy("pos").collect()]
    assert rules == ["academic-heading", "table-of-contents", "table-of-contents", None, None, "academic-heading", "bibliography", "bibliography", "academic-heading", None]
    body = context.masked(d).first().body
    assert len(body) == len(ACADEMIC) and [i for i, c in enumerate(body) if c == "\n"] == [i for i, c in enumerate(ACADEMIC) if c == "\n"]
    assert "גוף הטקסט" in body and "כהן" not in body


def test_phrases_repeat_within_lines_only(spark):
    p = "alpha beta gamma delta epsilon zeta eta theta"
    d = spark.createDataFrame([(1, f"{p}\n{p} x"), (2, p.replace("delta", "delta\n") + "\n" + p.replace("delta", "delta\n"))], "doc_id long, text string")
    rows = context.repeated_phrases(d).collect()
    assert [(r.doc_id, r.phrase, r["count"]) for r in rows] == [(1, p, 2)]


def test_cohort_scores_half_without_weights_and_refuses_what_it_must(spark):
    m = X.cohort_model()
    m["coefficients"] = [0.0] * 111
    rows = {r.doc_id: r.cohort for r in cohort.scored(X.hebrew(spark), m).collect()}
    assert (rows[1].status, rows[1].score, rows[1].reference_like) == ("scored", 0.5, True)
    assert [rows[k].status for k in (2, 3, 4)] == ["unsupported_niqqud_tokenization", "insufficient_text", "insufficient_text"]
    for key, bad in (("window", 300), ("scale", [0.0] * 111), ("threshold", 1), ("mean", [math.inf] * 111), ("train_source_ids", ["x"]), ("phrases", [])):
        with pytest.raises(cohort.InvalidModel):
            cohort.validated({**X.cohort_model(), key: bad})
    assert cohort.scored(X.hebrew(spark), {**m, "window": 1}).first().cohort.status == "invalid_artifact"


# --- office files ------------------------------------------------------------


@pytest.fixture(scope="module")
def parts(spark):
    return ooxml.parts(X.assets(spark)).cache()


def test_admission(parts):
    rows = {r.asset_id: r.status for r in parts.select("asset_id", "status").distinct().collect()}
    assert rows == {"made": "ok", "ordinary": "ok", "linked": "ok", "entities": "ok", "broken": "not_a_package", "climbs": "unsafe_name"}
    assert parts.where("asset_id = 'entities' and name = 'word/document.xml' and xml is not null").count() == 0


def test_a_large_part_is_refused(spark):
    big = X.docx(X.body(X.paragraph(X.run("x" * (9 << 20)))))
    assert ooxml.parts(spark.createDataFrame([("b", big)], "asset_id string, content binary")).first().status == "part_too_large"


def test_deleted_and_hidden_text_is_not_read(parts):
    rows = {r["index"]: r for r in ooxml.paragraphs(parts).where("asset_id = 'ordinary'").collect()}
    assert rows[3].text == "Before added text after" and (rows[3].inserted, rows[3].deleted) == (1, 1)
    assert rows[4].text == "Seen. " and rows[4].hidden == 1


def test_process_scores(parts):
    rows = {r.asset_id: r for r in process.process_scores(ooxml.structure(parts), ooxml.properties(parts)).collect()}
    assert rows["made"].score == min(100, 32 + 18 + 18 + 12 + 8 + 8 + 4) and rows["made"].status == "strong_assembly_signal"
    assert rows["ordinary"].score < 40 and "no_tracked_changes" not in rows["ordinary"].rules


def test_structure(parts):
    r = {x.asset_id: x for x in ooxml.structure(parts).collect()}["linked"]
    assert (r.macros, r.external_targets, r.local_paths, r.comment_authors) == (1, 2, 1, ["C"])


def test_run_between_sessions_is_a_candidate(parts):
    runs = ooxml.runs(parts)
    c = {(r.asset_id, r.text): r for r in process.run_candidates(runs).collect()}
    odd = c[("linked", "inserted words")]
    assert odd.score == 100 and {"rare_session", "between_sessions", "isolated_style", "language"} <= set(odd.evidence)
    text = "".join(r.text for r in runs.where("asset_id = 'linked'").orderBy("paragraph", "run").collect())
    assert text[odd.start : odd.end] == odd.text


def test_candidates_merge_while_scores_are_near(spark):
    rows = [("a", 0, 0, "x", 0, 1, 80, ["p"]), ("a", 0, 1, "y", 1, 2, 65, ["q"]), ("a", 0, 2, "z", 2, 3, 62, ["r"]), ("a", 0, 3, "w", 3, 4, 40, ["s"]), ("a", 1, 0, "v", 4, 5, 60, [])]
    d = spark.createDataFrame(rows, "asset_id string, paragraph int, run int, text string, start long, end long, score int, evidence array<string>")
    got = [(r.text, r.score, r.confidence) for r in process.merged_candidates(d).orderBy("rank").collect()]
    assert got == [("xyz", 80, "high"), ("v", 60, "medium"), ("w", 40, "low")]


def test_neighbourhood_takes_the_shorter_side_first(spark):
    rows = [("a", "p", i, "word " * n) for i, n in enumerate((50, 10, 5, 100, 100))]
    d = spark.createDataFrame(rows, "asset_id string, part string, index int, text string")
    got = {r["index"]: len(r.context.split()) for r in process.neighbourhoods(d, 60).collect()}
    assert got == {0: 60, 1: 65, 2: 65, 3: 100, 4: 100}


# --- media -------------------------------------------------------------------


def test_gray_stats_against_loops():
    g = np.random.default_rng(0).integers(0, 256, (9, 11)).astype(np.uint8)
    s = media.gray_stats(g)
    edge = noise = n = 0
    for y in range(1, 8):
        for x in range(1, 10):
            v = int(g[y, x])
            edge += abs(v - int(g[y, x - 1])) + abs(v - int(g[y - 1, x]))
            noise += abs(v - (int(g[y, x - 1]) + int(g[y, x + 1]) + int(g[y - 1, x]) + int(g[y + 1, x])) / 4)
            n += 1
    assert s["edge"] == pytest.approx(edge / (2 * n)) and s["noise"] == pytest.approx(noise / n)
    assert s["mean"] == pytest.approx(g.mean()) and media.gray_stats(np.full((8, 8), 7, np.uint8))["entropy"] == 0


def test_copied_patch_and_hashes():
    images = dict(X.pixels())
    gray = {k: (v @ [0.299, 0.587, 0.114]).astype(np.uint8) for k, v in images.items()}
    assert media.copied_patches(gray["copied"]) >= 1
    h = media.image_hashes(gray["noisy"])
    assert [len(h[k]) for k in ("ahash256", "dhash256", "phash64", "center_dhash64")] == [64, 64, 16, 16]
    assert int(h["phash64"], 16) >> 63 == 0


def test_containers(spark):
    rows = {r.asset_id: r for r in media.container_scores(X.containers(spark)).collect()}
    assert (rows["a.jpg"].trailing, rows["a.jpg"].photoshop, rows["a.jpg"].container_score) == (4, True, 18)
    assert (rows["b.png"].generators, rows["b.png"].container_score) == (["stable diffusion"], 85)
    assert rows["c.png"].trailing == 4 and "d.txt" not in rows


def test_sound(spark):
    rows = {r.asset_id: r for r in media.sound_features(X.sound(spark)).collect()}
    assert rows["tone"].identical_blocks == 3 and abs(rows["tone"].crossings - 880) < 2 and rows["loud"].clipped > 50
    assert not rows["text"].available


def test_mail(spark):
    r = {x.asset_id: x for x in media.mail(X.mail(spark)).collect()}
    assert r["m"].headers == {"from": "a@example.com", "subject": "last", "x-long": "v w"} and r["m"].body == "Body line\n\nmore"
    assert media.headers_of(X.MAIL)["from"] == "a@example.com"


def test_claims(spark):
    r = {x.asset_id: (x.present, x.valid, x.trusted, x.ai_declared) for x in media.claims(X.stores(spark)).collect()}
    assert r["trusted"] == r["v2"] == (True, True, True, True)
    assert r["valid"] == (True, True, False, True) and r["camera"] == (True, True, True, False) and r["failed"] == (True, False, False, True)
    assert r["inactive"] == r["none"] == r["bad"] == (False, False, False, False)


def test_regions_are_connected_and_ranked(spark):
    cells = [("a", x, y, 5, 90 if (x, y) in {(0, 0), (1, 0), (3, 3), (3, 4), (2, 2)} else 10) for x in range(5) for y in range(5)]
    d = spark.createDataFrame(cells, "asset_id string, gx int, gy int, rows int, score long")
    rows = fusion.regions(d).collect()
    assert [(r.x, r.y, r.x2, r.y2, r.cells) for r in rows] == [(0, 0, 1, 0, 2), (3, 3, 3, 4, 2)]


def test_fusion_weights_and_generator_floor(spark):
    d = spark.sql("select array(named_struct('id','a','score',80D,'weight',0.5D,'kind','origin'), named_struct('id','b','score',20D,'weight',0.5D,'kind','edit'), named_struct('id','c','score',100D,'weight',1D,'kind','counter')) signals, 10 camera, array() generators")
    f = fusion.fused()
    r = d.select(*(v.alias(k) for k, v in f.items())).first()
    assert (r.score, r.agreement, r.confidence) == (49, 50, "medium")
    r = d.withColumn("generators", F.array(F.lit("x"))).select(*(v.alias(k) for k, v in f.items())).first()
    assert (r.score, r.confidence) == (97, "very high")


def test_robust_z(spark):
    d = spark.createDataFrame([(0, float(v)) for v in (1, 2, 3, 4, 100)], "g int, v double")
    z = {r.v: r.z for r in matching.robust_z(d, "v", "g").collect()}
    assert z[100.0] == pytest.approx(97 / (1.4826 + 1e-6)) and z[3.0] == 0


def test_hash_similarity(spark):
    d = spark.createDataFrame([("ff" * 8, "ff" * 8), ("ff" * 8, "00" * 8), ("80" + "00" * 7, "00" * 8)], "a string, b string")
    s = matching.similarity(matching.hex_longs(F.col("a"), 1), matching.hex_longs(F.col("b"), 1))
    assert [r.s for r in d.select(s.alias("s")).collect()] == [1.0, 0.0, 1 - 1 / 64]


# --- training ----------------------------------------------------------------


def candidates(spark, n=60):
    r = np.random.default_rng(1)
    rows = [(f"{i:064x}", "ai" if i % 2 else "human", "approved", 2 + i % 2, {"rhythm": float(r.normal(i % 2 * 4)), "lexical": float(r.normal())}) for i in range(n)]
    rows += [("x", "mixed", "approved", 3, {}), ("y", "ai", "pending", 3, {}), ("z", "ai", "approved", 1, {})]
    return spark.createDataFrame(rows, "asset_sha256 string, proposed_label string, review_status string, trust_tier int, features map<string,double>")


def test_training_splits_scores_and_refuses(spark):
    rows = candidates(spark)
    parts = training.split(training.eligible(rows)).groupBy("y", "part").count().collect()
    assert {(r.y, r.part): r["count"] for r in parts} == {(y, p): n for y in (0, 1) for p, n in (("test", 6), ("train", 24))}
    m = training.train(rows)
    assert m["test"]["tp"] + m["test"]["tn"] >= 11 and m["features"] == list(training.FEATURES) and m["sd"][0] == 1
    held = training.split(training.eligible(rows)).where("part = 'test'").withColumn("x", training.vector())
    c = training.confusion(training.predicted(held, m)).first()
    assert (c.tp, c.tn, c.fp, c.fn) == tuple(m["test"][k] for k in ("tp", "tn", "fp", "fn"))
    assert training.may_promote(training.confusion(training.predicted(held, m))).count() == 1
    with pytest.raises(training.TooFew):
        training.train(candidates(spark, 12))
    row = training.registry_row(spark, m, "he", "essay", "2024-05-01 10:20:30").first()
    assert row.version == "he-essay-20240501102030" and row.status == "shadow" and len(row.artifact_sha256) == 64


def test_gradient_descent_is_full_batch_with_decay():
    x, y = np.array([[1.0], [-1.0]]), np.array([1, 0])
    w, b = training.descend(x, y, epochs=500)
    v = 0.0
    for _ in range(500):
        v -= training.RATE * ((1 / (1 + math.exp(-v)) - 1) + training.DECAY * v)
    assert w[0] == pytest.approx(v) and b == pytest.approx(0)


# --- records -----------------------------------------------------------------


def test_receipts(spark):
    d = spark.createDataFrame([(1, "Receipt\nItem 12.50\nItem 7.50\nTotal 20.00"), (2, "Receipt total 99.00 1.00 2.00"), (3, "nothing")], "doc_id long, text string")
    r = {x.doc_id: x for x in records.receipts(d).collect()}
    assert (r[1].likely, r[1].difference, r[1].consistent) == (True, 0.0, True)
    assert (r[2].difference, r[2].consistent) == (96.0, False) and r[3].consistent is None


def test_upserts_reviews_and_snapshots(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, records.upserted(t, new, "k").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    d = spark.sql("select 1 id, 'secret text' text, 'b' body, named_struct('words', 3, 'repeated_phrases', array('secret text')) profile")
    assert "secret" not in str(records.snapshot(d).first())
    c = spark.createDataFrame([(1, "pending", None), (2, "pending", None)], "id int, review_status string, reviewed_by string")
    r = records.reviewed(c, spark.createDataFrame([(2, "approved", "me")], "id int, status string, by string"))
    assert sorted(map(tuple, r.collect())) == [(1, "pending", None), (2, "approved", "me")]


def test_paths_and_accounts(spark):
    d = spark.createDataFrame([("u", "u/a"), ("u", "v/a"), ("u", "u/../v")], "user string, path string")
    assert [r.s for r in d.select(records.safe_path(F.col("user"), F.col("path")).alias("s")).collect()] == [True, False, False]
    flags = "id string, email string, provider string, providers array<string>, email_confirmed_at string, confirmed_at string, email_verified boolean, anonymous boolean"
    full = ("1", "a@b.c", "google", None, "2024", None, None, None)
    changed = [{}, {0: None}, {1: ""}, {2: "mail"}, {2: "mail", 3: ["mail", "google"]}, {4: None}, {4: "", 5: "2024"}, {4: None, 6: True}, {4: None, 6: False}, {7: True}, {7: False}]
    accounts = [tuple(c.get(i, v) for i, v in enumerate(full)) for c in changed]
    a = spark.createDataFrame(accounts, flags).coalesce(1).select(F.struct("*").alias("account"))
    assert [r.v for r in a.select(records.verified().alias("v")).collect()] == [True, False, False, False, True, False, True, True, False, False, True]


def test_fingerprints_are_hmacs(spark):
    visits = [("1.1.1.1, 2.2.2.2", "9.9.9.9", "agent", "he"), (None, "9.9.9.9", "é" * 600, "x" * 200), (" ,3.3.3.3", "8.8.8.8", "a", None), (None, None, "a", "he"), ("1.1.1.1", "9.9.9.9", "", "he")]
    d = spark.createDataFrame(visits, "forwarded string, ip string, agent string, language string").coalesce(1)
    for secret in ("secret", "k" * 100):
        want = [hmac.new(secret.encode(), m.encode(), "sha256").hexdigest() for m in ("1.1.1.1\nagent\nhe", "9.9.9.9\n" + "é" * 500 + "\n" + "x" * 120, "8.8.8.8\na\n")]
        assert [r.f for r in d.select(records.client_fingerprint(secret).alias("f")).collect()] == [*want, None, None]


def test_billing_events(spark):
    mac = hmac.new(b"s", b"17.body", "sha256").hexdigest()
    d = spark.createDataFrame([(f"t=17,v1=00,v1={mac}", "body"), (f"t=18,v1={mac}", "body"), (f"t=17,v1={mac}", "bod"), ("", "body"), (None, None)], "signature string, payload string").coalesce(1)
    assert [r.s for r in d.select(records.signature_holds("s").alias("s")).collect()] == [True, False, False, False, False]
    events = [(k, t, o, s, p, n) for k, (t, o, s, p, n) in enumerate([("checkout.session.completed", "", None, "p1", None), ("invoice.payment_failed", "open", "active", "p2", "pro"), ("invoice.paid", "paid", "trialing", None, "pro"), ("invoice.paid", "paid", None, None, None), ("customer.subscription.deleted", "canceled", None, "p1", None), ("customer.subscription.created", "", None, "p9", ""), ("charge.refunded", "x", None, "p1", None)])]
    e = spark.createDataFrame(events, "provider_event_id int, type string, object_status string, subscription_status string, price_id string, named_plan string").withColumns({"customer_id": F.lit(1), "ts": F.current_timestamp()})
    got = [(r.provider_event_id, r.status, r.plan) for r in records.billing_changes(e, {"p1": "starter", "p2": "business"}).orderBy("provider_event_id").collect()]
    assert got == [(0, "active", "starter"), (1, "past_due", "business"), (2, "trialing", "pro"), (3, "active", "free"), (4, "canceled", "starter"), (5, "inactive", "free")]


def test_files_are_read_by_kind_and_size(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("שלום".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "big.txt").write_bytes(b"x" * 5000)
    (tmp_path / "c.png").write_bytes(X.containers(spark).where("name = 'b.png'").first().content)
    f = files.files(spark, str(tmp_path), most_bytes=4000)
    assert {r.name: r.kind for r in f.collect()} == {"a.txt": "text", "bad.txt": "text", "c.png": "image"}
    assert [r.text for r in files.strict_text(f).collect()] == ["שלום"]
    out = tmp_path / "out"
    files.append_scans(spark.sql("select 1 id, timestamp '2024-01-02 03:04:05' created_at"), str(out))
    files.append_scans(spark.sql("select 2 id, timestamp '2024-01-02 05:04:05' created_at"), str(out))
    assert spark.read.parquet(str(out)).count() == 2


# --- ladders and adapters ----------------------------------------------------


def rows_of(spark, name):
    from glyphmill.plans import catalogue

    return {r.asset_id: r for r in catalogue.queries()[name](spark, "").collect()}


def test_boosts_and_regions(spark):
    assert {k: r.score for k, r in rows_of(spark, "image_boosts").items()} == {"a": 98, "b": 96, "c": 9, "d": 50}
    assert {k: (r.shown, r.votes) for k, r in rows_of(spark, "image_credible_regions").items()} == {"a": (80, 2), "b": (76, 3), "d": (20, 0)}


def test_document_chain(spark):
    from glyphmill.plans import catalogue

    got = [(r.asset_id, r.id, r.status, r.score) for r in catalogue.queries()["document_chain"](spark, "").orderBy("asset_id", "position").collect()]
    assert got[0] == ("a", "known_identity", "verified", 100)
    assert got[2] == ("a", "editing_sessions", "retained", 73)
    assert ("b", "authorship_regions", "unavailable", 0) in got and got[-1] == ("b", "assembly", "observed", 0)


def test_consensus_ladder(spark):
    from glyphmill.operators import verdicts

    cases = [(0, 0, 0, 80.0, "X", True, "VERIFIED_AI_PROVENANCE"), (2, 0, 0, 0.0, "X", False, "HIGH_AI_SIGNAL"), (1, 1, 0, 0.0, "X", False, "AI_OR_AI_ASSISTED"), (1, 0, 0, 80.0, "X", False, "HIGH_AI_SIGNAL"), (1, 0, 1, 80.0, "X", False, "INCONCLUSIVE"), (0, 1, 0, 10.0, "X", False, "AI_ASSISTED_SIGNAL"), (0, 0, 0, 10.0, "AI_RESIDUE", False, "AI_RESIDUE_FOUND"), (0, 0, 0, 60.0, "X", False, "MODERATE_LOCAL_AI_SIGNAL"), (0, 0, 2, 10.0, "X", False, "NO_AI_SIGNAL_FROM_ENSEMBLE"), (0, 0, 0, 10.0, "X", False, "INCONCLUSIVE")]
    d = spark.createDataFrame(cases, "ai int, mixed int, human int, ensemble double, ensemble_verdict string, verified boolean, want string")
    assert verdicts.consensus(d).where("consensus <> want").count() == 0


def test_absent_tools_and_flat_metadata(spark):
    flat = {k: r.fields for k, r in rows_of(spark, "flat_metadata").items()}
    assert flat == {"a": '{"exif.Make":"Canon","exif.n":"2"}', "b": "{}", "c": "{}"}


def test_group_medians_are_exact(spark):
    r = np.random.default_rng(3)
    rows = [(k, float(v)) for k, n in ((0, 1), (1, 2), (2, 1001), (3, 5000)) for v in (r.normal(size=n) if k != 3 else r.integers(0, 4, n))] + [(4, None), (2, None)]
    got = {x.k: x.median for x in matching.group_medians(spark.createDataFrame(rows, "k int, v double"), "v", "k").collect()}
    want = {k: float(np.median([v for g, v in rows if g == k and v is not None])) for k in range(4)}
    assert got == pytest.approx(want) and set(got) == {0, 1, 2, 3}


def test_blocks_of_known_hashes_change_nothing(spark):
    r = np.random.default_rng(4)
    h = lambda: "".join(r.choice(list("0123456789abcdef"), 16))
    known = spark.createDataFrame([(k, k % 3, h()) for k in range(60)], "vec_id long, label int, h string")
    queries = known.where("vec_id % 20 = 0").selectExpr("vec_id query_id", "h qh")
    whole = sorted(map(tuple, matching.nearest_hashes(queries, known).collect()))
    assert sorted(map(tuple, matching.nearest_hashes(queries, known, most=1).collect())) == whole and len(whole) == 15


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_hashes_compares_lists_and_not_rows(spark, monkeypatch):
    """Against brute force, with ties, repeated ids, copies, no hash, and lists longer than a turn; pairs are no rows that are sorted."""
    import random

    r = random.Random(5)
    h = lambda: f"{r.getrandbits(3) * 0x1100110011001100 | r.getrandbits(4):016x}"[-16:]
    rows = [(k if k % 50 else 40, f"l{k % 7}", h()) for k in range(700)] + [(None, "x", h()), (5000, "x", None)]
    asked = [(k, h()) for k in (40, 3, 77, 900)] + [(None, h())]
    known = spark.createDataFrame(rows, "vec_id long, label string, h string")
    queries = spark.createDataFrame(asked, "query_id long, qh string")
    monkeypatch.setattr(matching, "LIST", 64)
    df = matching.nearest_hashes(queries, known, 3, most=2)
    want = []
    for q, qh in asked[:4]:
        near = sorted(((int(qh, 16) ^ int(x, 16)).bit_count(), v, label) for v, label, x in rows if v is not None and v != q and x)
        want += [(q, v, round(1 - d / 64, 6)) for d, v, _ in near[:3]]
    got = [tuple(x) for x in df.collect()]
    assert sorted((x[0], x[1], x[3]) for x in got) == sorted(want) and {x[4] for x in got} == {1, 2, 3}
    assert all(any(v == x[1] and label == x[2] for v, label, _ in rows) for x in got)
    plan = plan_of(df)
    assert "collect_list" in plan and "bit_count" not in plan
    few = matching.nearest_hashes(queries, known.where("vec_id in (3, 5000)")).where("query_id = 77").collect()
    assert [(x.vec_id, x.rank) for x in few] == [(3, 1), (5000, 2)] and few[1].similarity is None
    assert matching.nearest_hashes(queries, known.where("false")).count() == matching.nearest_hashes(queries.where("false"), known).count() == 0


def test_perceptual_matches_compares_lists_and_not_rows(spark, monkeypatch):
    """The class of each query against brute force over all pairs, with ties, missing values and labels of neither kind."""
    import random

    r = random.Random(6)
    h = lambda: f"{r.getrandbits(4) << 200 | r.getrandbits(4) << 60 | r.getrandbits(3):064x}"
    rows = [(k, r.choice(["ai", "ai_edit", "human", "other", None]), h(), h(), r.choice([1.0, 1.5, 0.0, None])) for k in range(300)] + [(300, "ai", None, h(), 1.0), (None, "ai", h(), h(), 1.0)]
    asked = [(k, *rows[k][2:]) for k in (0, 20, 40)] + [(999, h(), h(), 1.2), (998, None, h(), 1.0)]
    known = spark.createDataFrame(rows, "known_id long, label string, ahash256 string, dhash256 string, aspect_ratio double")
    queries = spark.createDataFrame(asked, "query_id long, ahash256 string, dhash256 string, aspect_ratio double")

    def score(a, b):
        if None in (a[0], b[0]):
            return None
        bits = [(int(x, 16) ^ int(y, 16)).bit_count() for x, y in zip(a[:2], b[:2])]
        q, k = a[2], b[2]
        ratio = max(0.0, 1 - abs(q - k) / max(q, k)) if q and k else 1.0
        return round(0.40 * (1 - bits[0] / 256) + 0.50 * (1 - bits[1] / 256) + 0.10 * ratio + 1e-9, 4)

    want = {}
    for q, *a in asked:
        s = [(score(a, b), -v, label) for v, label, *b in rows if v is not None and v != q]
        s = [x for x in s if x[0] is not None]
        kind = lambda k: max((x[0] for x in s if (x[2] or "").startswith(k)), default=None)
        top = max(s, key=lambda x: x[:2], default=(None, 0, None))
        want[q] = (top[0], top[2], kind("ai"), kind("human")) if s else (None, None, None)
    monkeypatch.setattr(matching, "LIST", 64)
    df = matching.perceptual_class(matching.perceptual_matches(queries, known, most=2))
    got = {x.query_id: (x.best, x.best_label, x.best_ai, x.best_human) for x in df.collect()}
    got[998] = got[998][:1] + got[998][2:]
    assert got == want
    plan = plan_of(df)
    assert "collect_list" in plan and "bit_count" not in plan


def test_sample_points_are_exact(spark):
    d = spark.createDataFrame([(0, 100.0), (1, 25.0), (2, 0.0), (3, None)], "k int, d double")
    got = {x.k: x.p for x in d.select("k", media.sample_points(F.col("d")).alias("p")).collect()}
    assert got == {0: [8.0, 28.0, 50.0, 72.0, 92.0], 1: [2.0, 7.0, 12.5, 18.0, 23.0], 2: [0.0, 1.0, 2.0], 3: [0.0, 1.0, 2.0]}
