"""Stored rows: scan history, label upserts, candidates, plans, quotas, receipts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as T

# Plans and the megabytes that a file may have.
PLAN_MB = {"free": 15, "starter": 25, "pro": 50, "business": 100}

# Words of receipts.
RECEIPT_WORDS = ("receipt", "invoice", "total", "subtotal", "tax", "vat", "amount", "קבלה", "חשבונית", 'סה"כ', "סה״כ", 'מע"מ', "מע״מ", "לתשלום", "שולם")
AMOUNT = r"(?:₪|\$|€|£|USD|ILS|EUR)?\s*(-?[0-9]{1,7}(?:[,.][0-9]{1,2})?)(?:\s*(?:₪|\$|€|£|USD|ILS|EUR))?"
DATE = r"(?:[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-](?:20)?[0-9]{2,4}|20[0-9]{2}[/.\-][0-9]{1,2}[/.\-][0-9]{1,2})"


def pasted(texts: DataFrame, text: str = "text", least: int = 30, most: int = 250_000) -> DataFrame:
    """Texts of an admissible length."""
    return texts.where((F.length(T.trimmed(F.col(text))) >= least) & (F.length(text) <= most))


def safe_path(user: Column, path: Column) -> Column:
    """A stored object's path lies below its user's folder and does not climb."""
    return path.startswith(F.concat(user, F.lit("/"))) & ~F.contains(path, F.lit(".."))


def within_plan(files: DataFrame, plans: DataFrame) -> DataFrame:
    """files with most_mb and admitted; plans is a handful of rows and joined by name."""
    return files.join(plans, "plan", "left").withColumn("admitted", F.col("size") <= F.coalesce("most_mb", F.lit(PLAN_MB["free"])) * 1_000_000)


def verified(account: str = "account") -> Column:
    """Accounts with an id and an address, not anonymous, of the provider google (the first or one of several), whose address is confirmed in one of three ways."""
    a = F.col(account)
    there = lambda c: F.coalesce(a[c] != "", F.lit(False))
    google = F.coalesce(a["provider"] == "google", F.lit(False)) | F.coalesce(F.array_contains(a["providers"], "google"), F.lit(False))
    confirmed = there("email_confirmed_at") | there("confirmed_at") | F.coalesce(a["email_verified"], F.lit(False))
    return there("id") & there("email") & ~F.coalesce(a["anonymous"], F.lit(False)) & google & confirmed


def history(scans: DataFrame, user, n: int = 25) -> DataFrame:
    """A user's last scans."""
    return scans.where(F.col("user_id") == user).orderBy(F.desc("created_at"), "scan_id").limit(n)


def upserted(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with new's rows in place of those with the same key."""
    return table.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def reviewed(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates with the review status and reviewer of decisions (id, status, by)."""
    j = candidates.join(decisions.select("id", F.col("status").alias("__s"), F.col("by").alias("__b")), "id", "left")
    return j.withColumns({"review_status": F.coalesce("__s", "review_status"), "reviewed_by": F.coalesce("__b", "reviewed_by")}).drop("__s", "__b")


def snapshot(profiles: DataFrame) -> DataFrame:
    """Profiles without quotations: what may be stored of a text."""
    return profiles.withColumn("profile", F.col("profile").dropFields("repeated_phrases")).drop("text", "body")


def within_quota(events: DataFrame, most: int, period: str = "day") -> DataFrame:
    """events with their number within a user's period, and whether it is within the quota.

    A user's period is the window; numbers restart with it, so it stays small.
    """
    p = F.date_trunc(period, "ts")
    n = F.row_number().over(Window.partitionBy("user_id", p).orderBy("ts", "event_id"))
    return events.withColumns({"period": p, "used": n}).withColumn("allowed", F.col("used") <= most)


def hmac_sha256(secret: str, message: Column) -> Column:
    """HMAC in hexadecimal digits, as two hashes over padded keys."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def client_fingerprint(secret: str) -> Column:
    """Of the columns forwarded, ip, agent and language; null without an address or an agent.

    The first of several forwarded addresses counts, else the connection's own.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    forwarded = T.trimmed(F.split(text("forwarded"), ",")[0])
    ip, agent, language = F.when(forwarded != "", forwarded).otherwise(text("ip")), F.substring(text("agent"), 1, 500), F.substring(text("language"), 1, 120)
    return F.when((ip != "") & (agent != ""), hmac_sha256(secret, F.concat_ws("\n", ip, agent, language)))


def accounts_by_fingerprint(visits: DataFrame, secret: str) -> DataFrame:
    """fingerprint, accounts: how many accounts one client has used; visits without a fingerprint belong to no client."""
    rows = visits.withColumn("fingerprint", client_fingerprint(secret)).where("fingerprint is not null")
    return rows.groupBy("fingerprint").agg(F.count_distinct("user_id").alias("accounts"))


# The types of provider events that change an account.
BILLING_TYPES = ("checkout.session.completed", "customer.subscription.created", "customer.subscription.updated", "customer.subscription.deleted", "invoice.paid", "invoice.payment_failed")


def signature_holds(secret: str, header: str = "signature", payload: str = "payload") -> Column:
    """Whether a header "t=...,v1=..." has the payload's HMAC among its signatures."""
    parts = F.split(F.col(header), ",")
    at = F.substring(F.get(F.filter(parts, lambda x: x.startswith("t=")), F.lit(0)), 3, 1 << 20)
    mine = F.concat(F.lit("v1="), hmac_sha256(secret, F.concat(at, F.lit("."), F.col(payload))))
    return F.coalesce(F.array_contains(parts, mine), F.lit(False))


def billing_changes(events: DataFrame, prices: dict[str, str]) -> DataFrame:
    """provider_event_id, customer_id, ts, status, plan: what events of the known types say of an account; others say nothing.

    events: provider_event_id, type, customer_id, ts, object_status, subscription_status, price_id, named_plan.
    """
    kind = F.col("type")
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    status = (
        F.when(kind == "checkout.session.completed", "active")
        .when(kind == "invoice.payment_failed", "past_due")
        .when(kind == "invoice.paid", F.coalesce(given("subscription_status"), F.lit("active")))
        .otherwise(F.coalesce(given("object_status"), F.lit("inactive")))
    )
    by_price = F.create_map(*(F.lit(x) for kv in prices.items() for x in kv))
    plan = F.coalesce(F.try_element_at(by_price, F.col("price_id")), given("named_plan"), F.lit("free"))
    return events.where(kind.isin(*BILLING_TYPES)).select("provider_event_id", "customer_id", "ts", status.alias("status"), plan.alias("plan"))


def applied_once(billing: DataFrame) -> DataFrame:
    """The latest state of each customer after each provider event counts once."""
    once = billing.dropDuplicates(["provider_event_id"])
    return once.groupBy("customer_id").agg(F.max_by(F.struct("status", "plan", "provider_event_id"), F.struct("ts", "provider_event_id")).alias("s"), F.count("*").alias("events")).select("customer_id", "s.*", "events")


def receipts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Receipt words, amounts, dates, and whether a run of amounts adds up to the largest."""
    t = F.col(text)
    hits = F.filter(F.array(*map(F.lit, RECEIPT_WORDS)), lambda w: F.contains(F.lower(t), w))
    amounts = F.filter(F.transform(T.found(t, AMOUNT, 1), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double")), lambda x: (x > 0) & (x < 1e8))
    d = docs.select(key, F.size(hits).cast("long").alias("words"), amounts.alias("a"), F.size(F.slice(T.found(t, DATE), 1, 12)).cast("long").alias("dates"), t.rlike("₪|ILS|USD|EUR").alias("currency"))
    d = d.withColumn("likely", (F.col("words") >= 2) | (F.col("currency") & (F.size("a") >= 3)))
    top = F.array_max("a")
    at = F.array_position("a", top).cast("int")
    rest = F.concat(F.slice("a", F.lit(1), at - 1), F.slice("a", at + 1, F.size("a")))
    d = d.withColumns({"top": top, "rest": F.when(F.size("a") >= 3, rest)})
    sums = F.flatten(F.transform(F.slice("rest", 1, 12), lambda _, i: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda n: F.when(i + n <= F.size("rest"), F.abs(F.aggregate(F.slice("rest", i + 1, n), F.lit(0.0), lambda s, x: s + x) - F.col("top"))))))
    diff = F.when(F.col("likely") & (F.size("a") >= 3), F.array_min(sums))
    return d.select(key, "words", F.size("a").cast("long").alias("amounts"), "dates", "likely", F.round(diff, 2).alias("difference"), (diff <= F.greatest(F.lit(0.05), F.col("top") * 0.01)).alias("consistent"))
