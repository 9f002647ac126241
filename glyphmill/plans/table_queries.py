"""Queries over the other tables and over small inline fixtures, with DuckDB's SQL for the same rows.

Star-schema tables have no counterpart in the reference; they exercise inventory
rows at volume, which the docstrings name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import metrics as M
from glyphmill.functions import text as T
from glyphmill.operators import fusion, matching, records, training
from glyphmill.streaming import events as E

from .text_queries import sized, table

def _truth(spark, sf_dir):
    """Labelled texts by content: of equal ones the smallest doc_id's label."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    label = F.when(F.col("toxic") == 1, "mixed").when(F.col("quality") == 1, "human").otherwise("ai")
    return d.groupBy(F.sha2("text", 256).alias("file_sha256")).agg(F.min_by(label, "doc_id").alias("label"))


def doc_exact_ground_truth(spark, sf_dir):
    """Exact labels by content hash, the score that they settle, and the labels of a document's parts."""
    items = matching.exact_labels(table(spark, sf_dir, "documents").select("doc_id", "text"), _truth(spark, sf_dir))
    score = (F.col("doc_id") % 90).cast("int")
    parts = F.transform(F.sequence(F.lit(0), (F.length("text") / 1000).cast("int")), lambda i: F.struct(F.when(score >= 55, "likely_ai_signal").otherwise("low_signal").alias("label"), score.alias("score"), i.alias("part")))
    settled = matching.with_override(items.withColumns({"score": score, "items": parts}), items="items")
    return settled.select("doc_id", "sha256", "matched", "label", "score", matching.item_counts().alias("n")).select("doc_id", "sha256", "matched", "label", "score", "n.strong_ai_signal", "n.likely_ai_signal", "n.low_signal")


doc_exact_ground_truth.sql = """
with t as (select sha256(text) h, arg_min(case when toxic = 1 then 'mixed' when quality = 1 then 'human' else 'ai' end, doc_id) label from documents join labels using (doc_id) group by 1),
d as (select doc_id, sha256(text) sha256, label, length(text) // 1000 + 1 n, coalesce(label = 'ai', false) ai from documents left join t on sha256(text) = h)
select doc_id, sha256, label is not null matched, label, cast(case when ai then 100 else doc_id % 90 end as integer) score, cast(case when ai then n else 0 end as bigint) strong_ai_signal,
 cast(case when not ai and doc_id % 90 >= 55 then n else 0 end as bigint) likely_ai_signal, cast(case when not ai and doc_id % 90 < 55 then n else 0 end as bigint) low_signal from d
"""


def doc_duplicate_groups(spark, sf_dir):
    """Texts that several documents have."""
    return matching.duplicate_groups(table(spark, sf_dir, "documents"))


doc_duplicate_groups.sql = "select sha256(text) sha256, count(*) copies, min(doc_id) first_id from documents group by 1 having count(*) > 1"


def page_html_text(spark, sf_dir):
    """title and text length of pages, by tags; links and paths that point elsewhere (P10)."""
    p = table(spark, sf_dir, "pages")
    body = T.trimmed(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]+>|\s+", " "))
    return p.select("page_id", T.tag_text(F.col("html"), "title").alias("title"), F.length(F.regexp_replace(T.entities_decoded(body), " +", " ")).cast("long").alias("chars"), T.occurrences(F.col("html"), r'(?i)href="https?://').alias("links"), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"))


page_html_text.sql = r"""
with a as (select page_id, url, html, regexp_extract(html, '(?is)<(?:[A-Za-z0-9_]+:)?title(?:\s[^>]*)?>(.*?)</(?:[A-Za-z0-9_]+:)?title\s*>', 1) t, regexp_matches(html, '(?is)<(?:[A-Za-z0-9_]+:)?title(?:\s[^>]*)?>.*?</(?:[A-Za-z0-9_]+:)?title\s*>') h,
 regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>|\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') b from pages),
c as (select *, regexp_replace(regexp_replace(t, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') s from a)
select page_id, case when h then replace(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&#39;', chr(39)) end title,
 cast(length(regexp_replace(replace(replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&#39;', chr(39)), ' +', ' ', 'g')) as bigint) chars, cast(len(regexp_extract_all(html, '(?i)href="https?://')) as bigint) links, regexp_extract(url, '^[a-z]+://([^/]+)', 1) host from c
"""


def conv_residue(spark, sf_dir):
    """F16, A29 on conversations: residue and script by role."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.sum(T.residue_count(F.col("text"))).alias("residue"), F.sum(T.occurrences(F.col("text"), T.TOKEN)).alias("tokens"))


conv_residue.sql = rf"""
select role, count(*) turns, cast(sum({" + ".join(f"len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}'))" for p in T.RESIDUE)}) as bigint) residue, cast(sum(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+(?:[''’\-][\p{{L}}\p{{N}}]+)*'))) as bigint) tokens from conversations group by role
"""

# --- vectors -----------------------------------------------------------------


def emb_hamming_topk(spark, sf_dir):
    """Sign-bit hashes of the rows whose id is divisible by 20 against all others, the five nearest."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", matching.sign_hash(F.col("embedding")).alias("h"))
    return matching.nearest_hashes(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("h").alias("qh")), e)


emb_hamming_topk.sql = f"""
with e as (select vec_id, label, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) b from embeddings), q as (select vec_id query_id, b qb from e where vec_id % 20 = 0),
p as (select query_id, vec_id, label, round(1 - list_sum(list_transform(list_zip(qb, b), lambda z: case when z[1] <> z[2] then 1 else 0 end)) / 64, 6) similarity from e join q on vec_id <> query_id)
select query_id, vec_id, label, similarity, cast(r as integer) "rank" from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) r from p) where r <= 5
"""


def _known(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    role = F.when(F.col("vec_id") % 2 == 0, "synthetic").otherwise("original")
    # Neighbouring vectors stand for the two hashes of a file.
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), matching.sign_hash(F.col("embedding")).alias("center_dhash64"))
    return e.join(other, "vec_id").select(F.col("vec_id").alias("known_id"), "label", role.alias("lineage_role"), matching.sign_hash(F.col("embedding")).alias("phash64"), "center_dhash64")


def emb_pair_contrast(spark, sf_dir):
    """Each row against each lineage's synthetic and original member."""
    k = _known(spark, sf_dir)
    known = k.withColumn("lineage_group", F.col("label"))
    queries = k.select(F.col("known_id").alias("query_id"), "phash64", "center_dhash64")
    return matching.pair_class(matching.pair_contrast(queries, known)).withColumn("rank", F.col("rank").cast("int"))


emb_pair_contrast.sql = """
with e as (select a.vec_id, a.label, list_transform(a.embedding, lambda x: case when x > 0 then 1 else 0 end) p, list_transform(b.embedding, lambda x: case when x > 0 then 1 else 0 end) c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
k as (select label g, vec_id % 2 = 0 syn, arg_min(p, vec_id) p, arg_min(c, vec_id) c from e group by all),
q as (select vec_id query_id, p, c from e),
s as (select query_id, g, syn, 0.58 * (1 - list_sum(list_transform(list_zip(q.p, k.p), lambda z: case when z[1] <> z[2] then 1 else 0 end)) / 64) + 0.42 * (1 - list_sum(list_transform(list_zip(q.c, k.c), lambda z: case when z[1] <> z[2] then 1 else 0 end)) / 64) s from q cross join k),
t as (select query_id, g lineage_group, max(s) filter (syn) a, max(s) filter (not syn) o from s group by all),
u as (select query_id, lineage_group, round(a + 1e-9, 4) synthetic_similarity, round(o + 1e-9, 4) original_similarity, round(a - o + 1e-9, 4) margin, case when a >= o then 'synthetic' else 'original' end toward from t where a is not null and o is not null),
r as (select *, row_number() over (partition by query_id order by abs(margin) desc, lineage_group) k from u)
select * exclude (k), cast(k as integer) "rank", case when k = 1 then case when synthetic_similarity >= 0.82 and margin >= 0.04 then 'ai' when original_similarity >= 0.82 and margin <= -0.04 then 'human' else 'none' end end "class" from r where k <= 5
"""


def emb_perceptual_match(spark, sf_dir):
    """256-bit hashes of the rows whose id is divisible by 20 against all others, best by label, and the ladder of classes."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", matching.sign_hash(F.col("embedding")).alias("h"))
    four = F.concat("h", F.reverse("h"), "h", F.reverse("h"))
    rows = e.select("vec_id", F.when(F.col("label") % 2 == 0, "ai").otherwise("human").alias("label"), four.alias("ahash256"), F.concat("h", "h", "h", "h").alias("dhash256"), (1 + F.col("vec_id") % 5 / 10).alias("aspect_ratio"))
    q = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "ahash256", "dhash256", "aspect_ratio")
    return matching.perceptual_class(matching.perceptual_matches(q, rows.withColumnRenamed("vec_id", "known_id")))


_HEX = "array_to_string(list_transform(range(1, 65, 4), lambda i: substr('0123456789abcdef', 1 + cast(8 * b[i] + 4 * b[i + 1] + 2 * b[i + 2] + b[i + 3] as integer), 1)), '')"
emb_perceptual_match.sql = f"""
with e as (select vec_id, case when label % 2 = 0 then 'ai' else 'human' end label, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) b, 1 + vec_id % 5 / 10 ar from embeddings),
f as (select vec_id, label, ar, {_HEX} h from e),
g as (select vec_id, label, ar, h || reverse(h) || h || reverse(h) a, h || h || h || h d from f),
p as (select q.vec_id query_id, k.vec_id known_id, k.label, q.ar qa, k.ar ka, q.a qx, k.a kx, q.d qd, k.d kd from g q join g k on q.vec_id % 20 = 0 and k.vec_id <> q.vec_id),
s as (select query_id, known_id, label, round(0.4 * (1 - list_sum(list_transform(range(1, 65), lambda i: bit_count(xor(strpos('0123456789abcdef', substr(qx, i, 1)) - 1, strpos('0123456789abcdef', substr(kx, i, 1)) - 1)))) / 256)
 + 0.5 * (1 - list_sum(list_transform(range(1, 65), lambda i: bit_count(xor(strpos('0123456789abcdef', substr(qd, i, 1)) - 1, strpos('0123456789abcdef', substr(kd, i, 1)) - 1)))) / 256) + 0.1 * greatest(0.0, 1 - abs(qa - ka) / greatest(qa, ka)) + 1e-9, 4) s from p),
b as (select query_id, max(s) best, arg_max(label, (s, -known_id)) best_label, max(s) filter (label = 'ai') best_ai, max(s) filter (label = 'human') best_human from s group by query_id),
m as (select *, round(coalesce(best_ai, 0.0) - coalesce(best_human, 0.0), 4) margin from b)
select *, case when best >= 0.965 then best_label when best_ai >= 0.90 and margin >= 0.045 then 'ai' when best_human >= 0.90 and margin <= -0.045 then 'human' else 'none' end "class" from m
"""


def emb_robust_z(spark, sf_dir):
    """A3, A4: median, MAD and robust deviation of the first component within each label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("v"))
    return matching.robust_z(e, "v", "label").select("vec_id", "label", F.round("z", 4).alias("z"))


emb_robust_z.sql = """
with e as (select vec_id, label, cast(embedding[1] as double) v from embeddings), m as (select label, median(v) m from e group by label), d as (select label, m, greatest(median(abs(v - m)), 1e-6) d from e join m using (label) group by all)
select vec_id, label, round((v - m) / (1.4826 * d + 1e-6), 4) z from e join d using (label)
"""

# --- training ----------------------------------------------------------------


def _candidates(spark, sf_dir):
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    j = l.join(d, "doc_id")
    t = F.col("text")
    vector = F.create_map(F.lit("rhythm"), F.length(t) % 97 + 0.0, F.lit("lexical"), F.col("quality") * 30.0 + F.length(t) % 11, F.lit("entropy"), T.occurrences(t, "[A-Z]") / (F.length(t) + 1.0))
    label = F.when(F.col("toxic") == 1, "mixed").when(F.col("quality") == 1, "human").otherwise("ai")
    return j.select("doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("x")), 256).alias("asset_sha256"), label.alias("proposed_label"), F.when(F.col("doc_id") % 5 == 0, "pending").otherwise("approved").alias("review_status"), (F.col("doc_id") % 3 + 1).alias("trust_tier"), vector.alias("features"))


_CAND = r"""
with j as (select l.doc_id, quality, toxic, text from labels l join documents d using (doc_id)),
c as (select doc_id, sha256(cast(doc_id as varchar) || 'x') h, case when toxic = 1 then 'mixed' when quality = 1 then 'human' else 'ai' end label, case when doc_id % 5 = 0 then 'pending' else 'approved' end st, doc_id % 3 + 1 tier,
 length(text) % 97 + 0.0 rhythm, quality * 30.0 + length(text) % 11 lexical, len(regexp_extract_all(text, '[A-Z]')) / (length(text) + 1.0) entropy from j),
e as (select *, case when label = 'ai' then 1 else 0 end y from c where st = 'approved' and tier >= 2 and label in ('ai', 'human')),
s as (select *, case when (row_number() over (partition by y order by h) - 1) % 5 = 0 then 'test' else 'train' end part from e)
"""


def candidate_eligibility(spark, sf_dir):
    """Rows that may be trained on, and their label."""
    return training.eligible(_candidates(spark, sf_dir)).select("doc_id", "proposed_label", "y")


candidate_eligibility.sql = _CAND + "select doc_id, label proposed_label, y from e"


def train_split(spark, sf_dir):
    """Every fifth row of a class, in order of hash, is held out."""
    return training.split(training.eligible(_candidates(spark, sf_dir))).select("doc_id", "y", "part")


train_split.sql = _CAND + "select doc_id, y, part from s"


def train_stats(spark, sf_dir):
    """Mean and deviation of the training rows' features, over the whole feature list."""
    rows = training.split(training.eligible(_candidates(spark, sf_dir))).where("part = 'train'").withColumn("x", training.vector())
    wide = rows.select(*(F.col("x")[i].alias(k) for i, k in enumerate(training.FEATURES)))
    return training.column_stats(wide, list(training.FEATURES)).select("feature", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


train_stats.sql = _CAND + ", w as (select " + ", ".join(f"{k if k in ('rhythm', 'lexical', 'entropy') else '0.0'} v{i}" for i, k in enumerate(training.FEATURES)) + " from s where part = 'train') " + " union all ".join(f"select '{k}' feature, round(avg(v{i}), 6) mean, round(case when stddev_pop(v{i}) > 0 then stddev_pop(v{i}) else 1.0 end, 6) sd from w" for i, k in enumerate(training.FEATURES))


def train_metrics(spark, sf_dir):
    """A trained model's metrics on its held-out rows; empty with too few examples of a class."""
    rows = _candidates(spark, sf_dir)
    try:
        model = training.train(rows)
    except training.TooFew:
        return spark.createDataFrame([], "n long, tp long, tn long, fp long, fn long, accuracy double, precision double, recall double, specificity double, f1 double, balanced_accuracy double")
    held = training.split(training.eligible(rows)).where("part = 'test'").withColumn("x", training.vector())
    return training.confusion(training.predicted(held, model))


def confusion_matrix(spark, sf_dir):
    """A27 at volume: returned lines against a rule."""
    l = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.when(F.col("l_quantity") > 25, 0.9).otherwise(0.1).alias("p"))
    return training.confusion(l)


confusion_matrix.sql = """
with c as (select count(*) filter (y and h) tp, count(*) filter (not y and not h) tn, count(*) filter (not y and h) fp, count(*) filter (y and not h) fn from (select l_returnflag = 'R' y, l_quantity > 25 h from lineitem)),
r as (select *, tp + tn + fp + fn n, tp / (tp + fp) p, tp / (tp + fn) re, tn / (tn + fp) sp from c)
select n, tp, tn, fp, fn, round((tp + tn) / n, 4) accuracy, round(p, 4) "precision", round(re, 4) recall, round(sp, 4) specificity, round(2 * p * re / (p + re), 4) f1, round((re + sp) / 2, 4) balanced_accuracy from r
"""

# --- stored rows and events --------------------------------------------------


def scan_history_top25(spark, sf_dir):
    """A user's last 25 scans."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("scan_id"), "user_id", F.col("ts").alias("created_at"), "event_type")
    return records.history(e, 7)


scan_history_top25.sql = "select event_id scan_id, user_id, ts created_at, event_type from events where user_id = 7 order by ts desc, event_id limit 25"


def quota_window(spark, sf_dir):
    """Events within a daily quota of three."""
    q = records.within_quota(table(spark, sf_dir, "events"), 3)
    return q.select("event_id", "user_id", F.col("used").cast("long").alias("used"), "allowed")


quota_window.sql = "select event_id, user_id, n used, n <= 3 allowed from (select event_id, user_id, row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id) n from events)"


PRICES = {"price_0": "starter", "price_1": "pro", "price_2": "business"}


def _provider_events(spark, sf_dir):
    """The events as a provider would send them, each twice; those of one kind signed with another secret."""
    e = table(spark, sf_dir, "events")
    kinds = {"click": "customer.subscription.updated", "view": "charge.refunded", "purchase": "checkout.session.completed", "signup": "invoice.paid", "error": "invoice.payment_failed"}
    named = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    at, payload = F.unix_timestamp("ts").cast("string"), F.coalesce("props", F.lit(""))
    sign = lambda secret: F.concat(F.lit("t="), at, F.lit(",v1="), records.hmac_sha256(secret, F.concat(at, F.lit("."), payload)))
    e = e.select(
        F.concat(F.lit("evt_"), "event_id").alias("provider_event_id"), named[F.col("event_type")].alias("type"), F.col("user_id").alias("customer_id"), "ts",
        F.when(F.col("value") > 50, "trialing").otherwise("").alias("object_status"), F.when(F.col("value") > 50, "trialing").alias("subscription_status"),
        F.concat(F.lit("price_"), F.col("user_id") % 4).alias("price_id"), F.when(F.col("user_id") % 8 == 3, "pro").alias("named_plan"),
        payload.alias("payload"), F.when(F.col("value") > 90, sign("other")).otherwise(sign("secret")).alias("signature"),
    )
    return e.union(e)


def event_dedup(spark, sf_dir):
    """Signed provider events of the known types, each once, and the latest state of each customer."""
    e = _provider_events(spark, sf_dir).where(records.signature_holds("secret"))
    return records.applied_once(records.billing_changes(e, PRICES))


event_dedup.sql = """
with e as (select 'evt_' || event_id id, user_id, ts, case event_type when 'purchase' then 'active' when 'error' then 'past_due' when 'signup' then case when "value" > 50 then 'trialing' else 'active' end when 'click' then case when "value" > 50 then 'trialing' else 'inactive' end end status,
 case user_id % 4 when 0 then 'starter' when 1 then 'pro' when 2 then 'business' else case when user_id % 8 = 3 then 'pro' else 'free' end end plan from events where event_type <> 'view' and not coalesce("value" > 90, false))
select user_id customer_id, arg_max(status, (ts, id)) status, arg_max(plan, (ts, id)) plan, arg_max(id, (ts, id)) provider_event_id, count(*) events from e group by user_id
"""


def client_fingerprints(spark, sf_dir):
    """Accounts by client fingerprint."""
    u, f = F.col("user_id"), F.col("event_id")
    visits = table(spark, sf_dir, "events").select(
        "user_id", F.when(f % 3 == 0, F.concat(F.lit("10.0.0."), u % 5, F.lit(", 10.9.9.9"))).alias("forwarded"), F.when(f % 7 != 0, F.concat(F.lit("10.1.0."), u % 11)).alias("ip"), F.when(f % 5 != 0, F.concat(F.lit("agent/"), F.col("event_type"))).alias("agent"), F.when(u % 2 == 0, "he").alias("language")
    )
    return records.accounts_by_fingerprint(visits, "secret")


_PADS = [bytes(x ^ p for x in b"secret".ljust(64, b"\0")).hex() for p in (0x36, 0x5C)]
client_fingerprints.sql = f"""
with v as (select user_id, case when event_id % 3 = 0 then '10.0.0.' || (user_id % 5) when event_id % 7 <> 0 then '10.1.0.' || (user_id % 11) end ip, case when event_id % 5 <> 0 then 'agent/' || event_type end agent, case when user_id % 2 = 0 then 'he' else '' end lang from events)
select sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(ip || chr(10) || agent || chr(10) || lang)))) fingerprint, count(distinct user_id) accounts from v where ip is not null and agent is not null group by 1
"""


def verified_accounts(spark, sf_dir):
    """Accounts that may scan, by provider and confirmation."""
    k = F.col("c_custkey")
    text = lambda c, v: F.when(c, v)
    account = F.struct(
        k.cast("string").alias("id"), text(k % 13 != 0, F.col("c_name")).alias("email"), text(k % 2 == 0, F.lit("google")).alias("provider"), text(k % 3 == 0, F.array(F.lit("email"), F.lit("google"))).alias("providers"),
        text(k % 5 == 0, F.lit("2024-01-01")).alias("email_confirmed_at"), text(k % 7 == 0, F.lit("")).alias("confirmed_at"), text(k % 4 == 0, k % 8 == 0).alias("email_verified"), text(k % 11 < 2, k % 11 == 0).alias("anonymous"),
    )
    c = table(spark, sf_dir, "customer").withColumn("account", account)
    return c.select("c_custkey", records.verified().alias("verified"))


verified_accounts.sql = "select c_custkey, c_custkey % 13 <> 0 and c_custkey % 11 <> 0 and (c_custkey % 2 = 0 or c_custkey % 3 = 0) and (c_custkey % 5 = 0 or c_custkey % 8 = 0) verified from customer"


def status_counts(spark, sf_dir):
    """Counts by condition in one pass."""
    e = table(spark, sf_dir, "events")
    return e.agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in E.KINDS), F.count("*").alias("total"))


status_counts.sql = "select " + ", ".join(f"count(*) filter (event_type = '{k}') {k}" for k in E.KINDS) + ", count(*) total from events"


def event_tumbling(spark, sf_dir):
    """Extension of T1: events and value by day and kind."""
    return E.counted(table(spark, sf_dir, "events")).select("start", "event_type", "events", F.round("value", 4).alias("value"))


event_tumbling.sql = "select date_trunc('day', ts) \"start\", event_type, count(*) events, round(sum(value), 4) \"value\" from events group by all"


def event_sliding(spark, sf_dir):
    """Extension of T1: windows of a day every six hours."""
    return E.counted(table(spark, sf_dir, "events"), "1 day", "6 hours").select("start", "event_type", "events", F.round("value", 4).alias("value"))


event_sliding.sql = """
with e as (select *, time_bucket(interval '6 hours', ts) b from events), w as (select event_type, value, b - k * interval '6 hours' s from e, (select unnest([0, 1, 2, 3]) k))
select s "start", event_type, count(*) events, round(sum(value), 4) "value" from w group by all
"""


def event_session(spark, sf_dir):
    """Extension of T1: sessions of a user with pauses under six hours."""
    return E.sessions(table(spark, sf_dir, "events"), "6 hours")


event_session.sql = """
with a as (select *, case when ts < lag(ts) over (partition by user_id order by ts) + interval '6 hours' then 0 else 1 end n from events), b as (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) s from a)
select user_id, min(ts) "start", max(ts) + interval '6 hours' "end", count(*) events from b group by user_id, s
"""


def props_json(spark, sf_dir):
    """A key of JSON properties, malformed ones null."""
    e = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return e.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


props_json.sql = "select event_id, try_cast(json_extract_string(case when json_valid(props) then props end, '$.k') as bigint) k from events"


def plan_lookup(spark, sf_dir):
    """Orders by nation and region through small dimension tables."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    by = o.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    j = by.join(c, by["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == n["n_nationkey"]).join(r, F.col("n_regionkey") == r["r_regionkey"])
    return j.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.sum("orders").alias("orders"), F.sum("cents").alias("cents"))


plan_lookup.sql = "select r_name region, n_name nation, cast(count(*) as bigint) orders, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) cents from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all"


def plan_cap(spark, sf_dir):
    """File sizes against the caps of plans."""
    plans = spark.createDataFrame(list(records.PLAN_MB.items()), "plan string, most_mb int")
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 20_000).alias("size"), F.element_at(F.array(*map(F.lit, [*records.PLAN_MB, "other"])), (F.col("doc_id") % 5 + 1).cast("int")).alias("plan"))
    return records.within_plan(d, F.broadcast(plans)).groupBy("plan").agg(F.count("*").alias("files"), F.count_if("admitted").alias("admitted"))


plan_cap.sql = "with p(plan, mb) as (values " + ", ".join(f"('{k}', {v})" for k, v in records.PLAN_MB.items()) + f"), d as (select n_chars * 20000 size, ([{', '.join(repr(k) for k in [*records.PLAN_MB, 'other'])}])[cast(doc_id % 5 + 1 as integer)] plan from documents) select d.plan, count(*) files, count(*) filter (size <= coalesce(mb, 15) * 1000000) admitted from d left join p using (plan) group by d.plan"


def top_orders(spark, sf_dir):
    """L8 at volume: the hundred dearest orders."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


top_orders.sql = "select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100"


def best_by_group(spark, sf_dir):
    """W12 at volume: each customer's dearest order."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o")).select("o_custkey", "o.o_orderkey", "o.o_totalprice")


best_by_group.sql = "select o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) o_orderkey, max(o_totalprice) o_totalprice from orders group by o_custkey"


def weighted_fusion(spark, sf_dir):
    """Signals of each order fused, and blended with a prior."""
    o = table(spark, sf_dir, "orders")
    v = lambda k: ((F.col("o_orderkey") * k) % 101).cast("double")
    signals = F.array(*(F.struct(F.lit(i).alias("id"), v(k).alias("score"), F.lit(w).alias("weight"), F.lit(kind).alias("kind")) for i, k, w, kind in (("a", 7, 0.3, "origin"), ("b", 13, 0.2, "origin"), ("c", 29, 0.1, "edit"), ("d", 31, 0.07, "counter"))))
    layers = F.transform("signals", lambda s: F.struct(s["score"].alias("score"), (s["weight"] * 4).alias("weight"), (s["score"] > 20).alias("available")))
    d = o.select("o_orderkey", signals.alias("signals"), v(31).alias("camera"), F.array_compact(F.array(F.when(F.col("o_orderkey") % 50 == 0, "x"))).alias("generators"))
    f = fusion.fused()
    return d.withColumn("layers", layers).select("o_orderkey", f["score"].alias("score"), f["agreement"].alias("agreement"), f["confidence"].alias("confidence"), fusion.blended("layers", 40).alias("origin"))


weighted_fusion.sql = """
with v as (select o_orderkey k, o_orderkey * 7 % 101 a, o_orderkey * 13 % 101 b, o_orderkey * 29 % 101 c, o_orderkey * 31 % 101 d from orders),
f as (select *, (0.0::double + a * 0.3::double + b * 0.2::double + c * 0.1::double) / (0.0::double + 0.3::double + 0.2::double + 0.1::double) - d * 0.13::double raw, (case when a >= 55 then 1 else 0 end) + (case when b >= 55 then 1 else 0 end) + (case when c >= 55 then 1 else 0 end) n,
 0.0::double + (case when a > 20 then 0.3::double * 4 else 0 end) + (case when b > 20 then 0.2::double * 4 else 0 end) + (case when c > 20 then 0.1::double * 4 else 0 end) + (case when d > 20 then 0.07::double * 4 else 0 end) sw,
 0.0::double + (case when a > 20 then a * (0.3::double * 4) else 0 end) + (case when b > 20 then b * (0.2::double * 4) else 0 end) + (case when c > 20 then c * (0.1::double * 4) else 0 end) + (case when d > 20 then d * (0.07::double * 4) else 0 end) s from v),
g as (select *, floor(greatest(0, least(100, case when k % 50 = 0 then greatest(raw, 97) else raw end)) + 0.5) score, floor(n / 3 * 100 + 0.5) agreement, least(0.88::double, 0.28::double + sw / 12) bl from f)
select k o_orderkey, cast(score as bigint) score, cast(agreement as bigint) agreement, case when k % 50 = 0 then 'very high' when agreement >= 60 then 'high' when agreement >= 40 then 'medium' else 'low-medium' end confidence,
 cast(case when sw > 0 then floor(greatest(1, least(99, 40 * (1 - bl) + s / sw * bl)) + 0.5) else 40 end as bigint) origin from g
"""


def upserted_labels(spark, sf_dir):
    """K3: labels with some rows replaced and some new."""
    l = table(spark, sf_dir, "labels")
    new = l.where("toxic = 1").withColumn("quality", 1 - F.col("quality")).unionByName(spark.createDataFrame([(-1, 1, 0)], l.schema))
    return records.upserted(l, new, "doc_id")


upserted_labels.sql = "select * from labels where toxic <> 1 union all select doc_id, cast(1 - quality as integer), toxic from labels where toxic = 1 union all select -1, 1, 0"


def registry_promotion(spark, sf_dir):
    """A shadow model becomes active, the one before it retired."""
    rows = [("m1", "he", "essay", "active"), ("m2", "he", "essay", "shadow"), ("m3", "en", "essay", "active"), ("m4", "he", "news", "shadow"), ("m5", "he", "essay", "retired")]
    r = spark.createDataFrame(rows, "version string, language string, domain string, status string").withColumn("activated_at", F.lit(None).cast("timestamp"))
    return training.promoted(r, "m2", "2024-05-01 00:00:00")


registry_promotion.sql = "select * from (values ('m1', 'he', 'essay', 'retired', null::timestamp), ('m2', 'he', 'essay', 'active', timestamp '2024-05-01 00:00:00'), ('m3', 'en', 'essay', 'active', null), ('m4', 'he', 'news', 'shadow', null), ('m5', 'he', 'essay', 'retired', null)) v(version, language, domain, status, activated_at)"


def pasted_texts(spark, sf_dir):
    """S3: texts that the paste form would take."""
    return records.pasted(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.length("text").cast("long").alias("chars"))


pasted_texts.sql = r"select doc_id, cast(length(text) as bigint) chars from documents where length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 30 and length(text) <= 250000"


def benchmark_contamination(spark, sf_dir):
    """Documents that share eight words in a row with a benchmark item.

    Shingles meet as hashes in an equi-join; the benchmark's are the small side, and the optimiser sees its size.
    """

    def shingles(t: DataFrame, key: str) -> DataFrame:
        grams = M.ngram_hashes(F.transform(T.tokens(F.col("text")), F.lower), 8)
        return sized(t).select(key, F.explode(F.array_distinct(grams)).alias("g"))

    d, b = shingles(table(spark, sf_dir, "documents"), "doc_id"), shingles(table(spark, sf_dir, "benchmark"), "item_id").select("g").distinct()
    return d.join(b, "g", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared"))


benchmark_contamination.sql = r"""
with x as (select 'd' k, doc_id id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*'), lambda x: lower(x)) w from documents union all select 'b', item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*'), lambda x: lower(x)) from benchmark),
g as (select distinct k, id, array_to_string(w[i:i + 7], ' ') g from (select k, id, w, unnest(range(1, len(w) - 6)) i from x where len(w) >= 8))
select id doc_id, count(*) shared from g where k = 'd' and g in (select g from g where k = 'b') group by id
"""

QUERIES = (
    doc_exact_ground_truth, doc_duplicate_groups, benchmark_contamination, page_html_text, conv_residue, emb_hamming_topk, emb_pair_contrast, emb_perceptual_match, emb_robust_z, candidate_eligibility, train_split, train_stats, train_metrics, confusion_matrix,
    scan_history_top25, quota_window, event_dedup, client_fingerprints, verified_accounts, status_counts, event_tumbling, event_sliding, event_session, props_json, plan_lookup, plan_cap, top_orders, best_by_group, weighted_fusion, upserted_labels, registry_promotion, pasted_texts,
)
