"""Information-theoretic sanitisation of personal data, DataFrame functions only.

Protected entities are e-mail addresses, IP addresses, payment cards and phone
numbers. Where they stand is found by patterns and checked by rules. Then the
corpus tells which other terms give an entity away: a term that stands anywhere
in documents with the entity (outside e-mail addresses) discloses it by the
ratio of their pointwise mutual information to the entity's information,

    log2(n(e,t) N / (n(e) n(t))) / log2(N / n(e)),

counted in documents (rows of the table). The ratio is 1 for a term that occurs in no document
without the entity. In every document that holds the entity, terms from
``GENERALISE`` on are replaced by their kind and terms from ``REMOVE`` on go.
Pairs need ``SUPPORT`` different texts, so a chance meeting discloses nothing;
documents without an entity are left alone.

Most entities stand in one document only, so what gives away that one is near
is counted as well: every entity belongs to its kind and to a narrower class
(mail domain, first three parts of an IP address, first six digits of a card or
phone number), and terms disclose these classes by the same ratio. Classes hold
many documents and meet many terms, so such a pair also needs ``EVIDENCE`` bits:
its documents times its pointwise mutual information.

Rows: a null text counts as empty and has no spans; rows that repeat id and
text get the same result each; null ids take part; a text of any length is
searched whole, in time linear in its length; an empty table gives no rows.
Only ``doc_id`` and ``text`` are read. Places count code points from 0, ends
are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.session import materialize

#: A match can begin only where a run of its characters begins (or where the
#: last match ended), and repeats never give back what they took: that changes
#: no match and keeps the search linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: a text without this has no match of the kind
HINTS = {"email": "@", "ip": ".", "phone": "+"}
GENERALISE, REMOVE = 0.6, 0.9
SUPPORT = 3
#: bits; a chance of one in four million for documents that meet at random
EVIDENCE = 22
NOT_LETTERS = r"[^\p{L}]+"
TERM_KINDS = ["generalised", "removed"]


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        def small(part: Column) -> Column:
            plain = F.regexp_replace(part, "^0+", "")
            return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function(
            "luhn_check", F.when(F.length(digits) <= 19, digits).otherwise("1"))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def located(df: DataFrame, keys: list[str], text: str, pattern: Column) -> DataFrame:
    """``keys``, place in order ``i``, ``value``, ``start`` and the text
    ``before`` and ``after`` each match (up to the next one). ``pattern`` may
    differ from row to row; ``keys`` must be unique."""
    found = df.select(*keys, F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"),
                      F.split(text, pattern, -1).alias("gaps")).where(F.size("m") > 0)
    rows = found.select(*keys, "gaps", F.posexplode("m").alias("i", "value")).select(
        *keys, "i", "value", F.col("gaps")[F.col("i")].alias("before"), F.col("gaps")[F.col("i") + 1].alias("after"))
    w = Window.partitionBy(*keys).orderBy("i")
    ends = F.sum(F.length("before") + F.length("value")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start", (ends - F.length("value")).cast("long"))


def _terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters outside e-mail addresses (no other
    entity holds letters)."""
    plain = F.when(F.contains(text, F.lit(HINTS["email"])), F.regexp_replace(text, F.lit(PATTERNS["email"]), F.lit(" ")))
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(plain, text)), NOT_LETTERS)), "")


def holders(docs: DataFrame) -> DataFrame:
    """(doc_id, a, text, copies): the distinct documents that may hold an
    entity and the number of their rows; a is a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("a", F.xxhash64("text"))
    copies = F.count("*").alias("copies")
    return materialize(rows.groupBy("doc_id", "a").agg(F.first("text").alias("text"), copies), "pii-holders")


def entities(held: DataFrame) -> DataFrame:
    """A row per valid match: doc_id, a, kind, value, start."""
    out = None
    for kind, pattern in PATTERNS.items():
        has = F.contains("text", F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
        rows = located(held.where(has), ["doc_id", "a"], "text", F.lit(pattern)).where(valid(kind, F.col("value")))
        rows = rows.select("doc_id", "a", F.lit(kind).alias("kind"), "value", "start")
        out = rows if out is None else out.unionAll(rows)
    return materialize(out, "pii-entities")


def protected(found: DataFrame) -> DataFrame:
    """doc_id, a, entity, wide: what the entities of a document stand for: each
    by itself, and (``wide``) its kind and its narrower class."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    part = (F.when(F.col("kind") == "email", F.lower(F.substring_index("value", "@", -1)))
            .when(F.col("kind") == "ip", F.substring_index("value", ".", 3)).otherwise(F.substring(digits, 1, 6)))
    names = F.array(F.struct(F.concat_ws(":", "kind", F.lower("value")).alias("entity"), F.lit(False).alias("wide")),
                    F.struct(F.concat_ws(":", F.lit("class"), "kind", part).alias("entity"), F.lit(True).alias("wide")),
                    F.struct(F.concat_ws(":", F.lit("kind"), "kind").alias("entity"), F.lit(True).alias("wide")))
    return found.select("doc_id", "a", F.explode(names).alias("name")).select("doc_id", "a", "name.*").distinct()


def disclosing_terms(docs: DataFrame, held: DataFrame, found: DataFrame) -> DataFrame:
    """(a, term, disclosure) of all terms of the texts a that disclose an
    entity of theirs, or its class, by ``GENERALISE`` or more. Entities, terms
    and their meetings are all counted in rows of ``docs``, whole texts each."""
    copies = held.select(F.col("doc_id").alias("d"), F.col("a").alias("b"), "copies")
    met = (protected(found).join(copies, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("a") == F.col("b")))
           .groupBy("entity", "wide", "a").agg(F.sum("copies").alias("copies")))
    met = materialize(met, "pii-met")
    # an entity in too few texts has no pair with support
    known = met.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts")).where(
        F.col("texts") >= SUPPORT).select("entity", "n_e")
    known = met.join(known, "entity")
    texts = held.groupBy("a").agg(F.first("text").alias("text"))
    texts = texts.join(known.select("a").distinct(), "a").select("a", _terms(F.col("text")).alias("terms"))
    met_terms = materialize(known.join(texts, "a").select("entity", "wide", "n_e", "a", "copies", F.explode("terms").alias("term")),
                            "pii-met-terms")
    pairs = (met_terms.groupBy("entity", "wide", "n_e", "term").agg(F.sum("copies").alias("n_et"), F.count("*").alias("texts"))
             .where(F.col("texts") >= SUPPORT))
    pairs = materialize(pairs, "pii-pairs")
    n_term = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.agg(F.count("*").alias("n")).where("n > 0")
    shared = F.log2(F.col("n_et") * F.col("n") / (F.col("n_e") * F.col("n_t")))
    telling = (pairs.join(n_term, "term").join(F.broadcast(total)).where(F.col("n") > F.col("n_e"))
               .where(~F.col("wide") | (F.col("n_et") * shared >= EVIDENCE))
               .select("entity", "term", (shared / F.log2(F.col("n") / F.col("n_e"))).alias("disclosure"))
               .where(F.col("disclosure") >= GENERALISE))
    telling = materialize(telling, "pii-telling")
    return met_terms.join(telling, ["entity", "term"]).groupBy("a", "term").agg(F.max("disclosure").alias("disclosure"))


def spans(docs: DataFrame) -> DataFrame:
    """All spans: doc_id, a, kind, start, end, value."""
    held = holders(docs)
    found = entities(held)
    base = found.select("doc_id", "a", "kind", "start", (F.col("start") + F.length("value")).alias("end"), "value")
    told = (disclosing_terms(docs, held, found)
            .groupBy("a", F.when(F.col("disclosure") >= REMOVE, "removed").otherwise("generalised").alias("kind"))
            # longest first: of two alternatives the pattern takes the first
            .agg(F.array_join(F.sort_array(F.collect_set("term"), asc=False), "|").alias("terms")))
    told = materialize(told, "pii-told")
    texts = held.join(told, "a").select("doc_id", "a", "text", "kind", F.concat(
        F.lit(r"(?iu)(?<!\p{L})(?:"), "terms", F.lit(r")(?!\p{L})")).alias("pattern"))
    terms = located(texts, ["doc_id", "a", "kind"], "text", F.col("pattern"))
    return base.unionAll(terms.select("doc_id", "a", "kind", "start", (F.col("start") + F.length("value")).alias("end"),
                                      "value"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, a (hash of the text) and ``found``, the
    array of its spans (k: place of the kind in the list of kinds, start, end,
    kind) in that order."""
    order = F.array_position(F.array(*map(F.lit, KINDS + TERM_KINDS)), F.col("kind")).cast("int")
    by_doc = (spans(docs).groupBy("doc_id", "a")
              .agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), "start", "end", "kind"))).alias("found")))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("a"))
    same = rows["doc_id"].eqNullSafe(by_doc["doc_id"]) & (rows["a"] == by_doc["a"])
    empty = F.array().cast("array<struct<k:int,start:bigint,end:bigint,kind:string>>")
    return rows.join(by_doc, same, "left").select(rows["doc_id"], rows["a"], F.coalesce("found", empty).alias("found"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with entities and generalised terms replaced by
    their kind in brackets and removed terms taken out; where spans overlap
    the one that begins first holds (then the longer one)."""
    found = find_personal_data(docs).where(F.size("found") > 0).dropDuplicates(["doc_id", "a"])
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("a"))
    by_start = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"),
                                                                    s["kind"].alias("kind"))))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["a"] == found["a"]), "left").select(
        rows["doc_id"], "text", by_start.alias("by_start"))
    done = F.aggregate(
        "by_start", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
            (-s["back"]).alias("at"),
            F.concat(acc["out"], F.array(
                F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]"))))).alias("out"))))
    return joined.withColumn("done", done).select("doc_id", F.when(F.col("by_start").isNull(), F.col("text")).otherwise(
        F.concat(F.array_join("done.out", ""), F.expr("substring(text, cast(done.at as int) + 1)"))).alias("text"))
