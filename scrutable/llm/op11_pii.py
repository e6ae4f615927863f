"""Personal data: patterns, and terms that reveal it by corpus co-occurrence; DataFrame functions only.

Emails, IPv4 addresses, card numbers (Luhn) and phone numbers are found by pattern, in code points. They are
the entities to protect. A term (a lower-cased run of three letters or more) discloses an entity as far as it
predicts it: with n texts, n_e of them holding the entity, n_t the term, and n_both the term within `around`
code points of the entity, the term's pointwise mutual information with it is log2(n n_both / (n_e n_t)), and
its disclosure is that as a share of the entity's own information, log2(n / n_e). 1 says that the term is
found beside the entity only. Terms seen beside an entity in at least `contexts` different surroundings whose
disclosure reaches `generalise` are generalised to what kind of word they are, and removed from `remove` on.
They are marked wherever they occur, also where the entity itself is absent, since there they give it away.

All counts are over all texts; equal texts count once, so that copies are no evidence. Pairs are made of an
entity's surroundings only, so they follow the number of entities, and are counted before they are shuffled.
How many texts of a sixteenth, by hash, hold a term is a lower bound of n_t; most words are by that too common
to disclose anything. Every text's words then meet the terms that are left in one pass, which leaves (text, term)
rows of these alone, and the counts that decide are taken from all texts.
Candidates, disclosing terms and texts that hold them are broadcast up to `most_bytes` measured bytes and
shuffled beyond. Texts are known by their SHA-256 between passes.

Null texts are empty and hold nothing. Repeated rows and rows without doc_id have a row each. Terms inside an
email are not terms; matches of different patterns may overlap. A corpus in which every text holds an entity
gives that entity no information to disclose. Other columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, hinted, merged

KINDS = ("email", "ip", "card", "phone")
#: The patterns, without a second look at a run of characters that has failed and without recursion. A local part
#: starts where no character of its kind is before it, or where the last match ended; numbers likewise. A card's
#: digits are a whole run of 16 to 19 with single blanks or dashes between them, as no other run can pass.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "phone": "+"}
BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
TERM = r"\p{L}{3,}"
SPAN = "array<struct<start:int,end:int,value:string,near:string>>"


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once a row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column) -> Column:
    """Sums of the first one, two, three... numbers of an array, in blocks of the root of its size."""
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("bigint"))
    none = F.array().cast("array<bigint>")

    def blocks(a):
        size = F.ceil(F.sqrt(F.size(a))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int")), lambda b: F.slice(a, b * size + 1, size))

    inside = lambda a: F.transform(blocks(a), lambda x: F.aggregate(x, none, lambda acc, n: F.array_append(acc, last(acc) + n)))
    before = lambda w: F.slice(F.aggregate(w, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.array_append(acc, last(acc) + last(x))), F.lit(1), F.size(w))
    joined = lambda w: F.flatten(F.zip_with(w, before(w), lambda x, base: F.transform(x, lambda n: n + base)))
    return let(numbers, lambda a: F.when(F.size(a) > 0, let(inside(a), joined)).otherwise(none))


def matched(text: Column, pattern: str) -> Column:
    """Every match of `pattern` as (start, end, value, before, behind), in code points, with the text up to its neighbours; null for none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ends = lambda v, p: running(F.zip_with(v, F.slice(p, F.lit(1), F.size(v)), lambda x, y: (F.length(x) + F.length(y)).cast("bigint")))
    spans = lambda v, p: F.zip_with(v, ends(v, p), lambda x, e: F.struct((e - F.length(x)).cast("int").alias("start"), e.cast("int").alias("end"), x.alias("value")))
    sides = lambda v, p: F.zip_with(F.slice(p, F.lit(1), F.size(v)), F.slice(p, F.lit(2), F.size(v)), lambda x, y: F.struct(x.alias("before"), y.alias("behind")))
    both = lambda v, p: F.zip_with(spans(v, p), sides(v, p), lambda x, y: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), y["before"].alias("before"), y["behind"].alias("behind")))
    return let(found, lambda v: F.when(F.size(v) > 0, let(F.split(text, pattern, -1), lambda p: both(v, p))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of `value` pass the Luhn check."""
    d = F.reverse(digits(value))
    one = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    twice = lambda n: n - F.when(n > 9, 9).otherwise(0)
    worth = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.when(i % 2 == 0, twice(one(i) * 2)).otherwise(one(i)))
    return F.aggregate(worth, F.lit(0), lambda acc, n: acc + n) % 10 == 0


PASSES = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$"),
    "card": luhn,
    "phone": lambda v: F.length(digits(v)).between(8, 15),
}


def located(kind: str, around: int) -> Column:
    """The matches of a kind in column `text` that pass, with places and what stands around them."""
    tail = lambda s: F.when(F.length(s) > around, F.regexp_replace(F.right(s, F.lit(around)), r"^[^\x20\x09-\x0D]++", "")).otherwise(s)
    head = lambda s: F.when(F.length(s) > around, F.regexp_replace(F.left(s, F.lit(around)), r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]++\z", "")).otherwise(s)
    kept = F.filter(matched(F.col("text"), PATTERNS[kind]), lambda m: PASSES[kind](m["value"]))
    spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), F.concat(tail(m["before"]), F.lit(" "), head(m["behind"])).alias("near")))
    spans = F.when(F.contains("text", F.lit(NEEDS[kind])), spans) if kind in NEEDS else spans
    return F.coalesce(spans, F.array().cast(SPAN)).alias(kind)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))


def scrubbed(text: Column) -> Column:
    """The text with emails as zeros of their length, so that places stay."""
    zeros = F.concat(F.transform(F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0)), lambda v: F.repeat(F.lit("0"), F.length(v))), F.array(F.lit("")))
    clean = F.array_join(F.zip_with(F.split(text, PATTERNS["email"], -1), zeros, lambda a, b: F.concat(a, b)), "")
    return F.when(F.contains(text, F.lit("@")), clean).otherwise(text)


def base_spans(docs: DataFrame, around: int = 120, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, email, ip, card, phone): every row's matches, and the digest by which its text is known."""
    return keyed(docs, id_col, text_col).select("doc_id", "key", *[located(k, around) for k in KINDS])


def entities(base: DataFrame) -> DataFrame:
    """(entity, key, near) of every match: its kind and plain value, the text, the surroundings."""
    plain = {"email": F.lower, "ip": lambda v: v, "card": digits, "phone": digits}
    named = lambda k: F.transform(k, lambda m: F.struct(F.concat(F.lit(f"{k}:"), plain[k](m["value"])).alias("entity"), m["near"].alias("near")))
    each = F.concat(*[named(k) for k in KINDS])
    return base.where(" OR ".join(f"size({k}) > 0" for k in KINDS)).select("key", F.explode(each).alias("m")).select("m.entity", "key", "m.near")


def disclosing(docs: DataFrame, base: DataFrame, contexts: int = 3, generalise: float = 0.9, most_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(term, disclosure) of the terms to mask, and (key, term) of where they occur; both written tables."""
    told = cut(entities(base).distinct())
    terms = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("near"), F.lit(TERM), F.lit(0))))
    pairs = cut(told.select("entity", "key", F.xxhash64("near").alias("context"), terms.alias("term")).distinct())
    n = base.select("key").distinct().count()
    n_e = told.select("entity", "key").distinct().groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") < n)
    share = lambda both, t: 1 + F.log2(both / t) / F.log2(F.lit(n) / F.col("n_e"))
    often = pairs.groupBy("entity", "term").agg(F.count_distinct("context").alias("n"), F.count_distinct("key").alias("n_most")).where(F.col("n") >= contexts)
    often = cut(merged(often.select("entity", "term", "n_most"), n_e, "entity"))
    least = occurrences(docs, cut(often.select("term").distinct()), most_bytes, id_col, text_col, F.hex("key").startswith("0")).groupBy("term").agg(F.count("*").alias("n_least"))
    able = merged(often, least, "term", "left").where(share(F.col("n_most"), F.greatest("n_most", "n_least")) >= generalise)
    able = cut(able.select("entity", "term", "n_e"))
    held = cut(occurrences(docs, cut(able.select("term").distinct()), most_bytes, id_col, text_col))
    n_t = held.groupBy("term").agg(F.count("*").alias("n_t"))
    seen = merged(pairs.select("entity", "term", "key").distinct(), able, ["entity", "term"])
    both = merged(seen, held, ["key", "term"], "left_semi").groupBy("entity", "term", "n_e").agg(F.count("*").alias("n_both"))
    known = merged(both, n_t, "term").select("term", share(F.col("n_both"), F.col("n_t")).alias("disclosure"))
    flagged = cut(known.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= generalise))
    return flagged, cut(held.join(hinted(flagged, most_bytes), "term").select("key", "term", "disclosure"))


def occurrences(docs: DataFrame, terms: DataFrame, most_bytes: int, id_col: str, text_col: str, among: Column | None = None) -> DataFrame:
    """(key, term): which texts, of those with `among` where it is given, hold which of the terms; equal texts once."""
    rows = keyed(docs, id_col, text_col)
    rows = rows if among is None else rows.where(among)
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(scrubbed(F.col("text"))), F.lit(TERM), F.lit(0))))
    return rows.select("key", words.alias("term")).join(hinted(terms, most_bytes), "term", "left_semi").distinct()


def term_spans(docs: DataFrame, where: DataFrame, most_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, term): the places of disclosing terms in each text that holds some, with their disclosure."""
    texts = cut(where.groupBy("key").agg(F.collect_list("term").alias("terms"), F.collect_list("disclosure").alias("shares")))
    df = keyed(docs, id_col, text_col).select("key", "text").join(texts.hint("broadcast" if where.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0] <= most_bytes else "merge"), "key")
    place = lambda m: let(F.array_position("terms", F.lower(m["value"])).cast("int"), lambda i: F.when(i > 0, F.get("shares", i - 1)))
    every = F.transform(matched(scrubbed(F.col("text")), TERM), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), place(m).alias("disclosure")))
    return df.select("key", F.filter(every, lambda m: m["disclosure"].isNotNull()).alias("term")).dropDuplicates(["key"])


def find(docs: DataFrame, around: int = 120, contexts: int = 3, generalise: float = 0.9, most_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, email, ip, card, phone, term) of every row: arrays of spans, those of terms with their disclosure."""
    base = cut(base_spans(docs, around, id_col, text_col))
    _, where = disclosing(docs, base, contexts, generalise, most_bytes, id_col, text_col)
    terms = cut(term_spans(docs, where, most_bytes, id_col, text_col))
    bounded = where.agg(F.coalesce(F.count("*"), F.lit(0))).first()[0] * 64 <= most_bytes
    out = base.join(terms.hint("broadcast" if bounded else "merge"), "key", "left")
    return out.withColumn("term", F.coalesce("term", F.array().cast(terms.schema["term"].dataType)))


def listed(kind: str) -> Column:
    return F.transform(kind, lambda m: F.concat(F.lit(f"{kind}:"), m["start"].cast("string"), F.lit(":"), m["end"].cast("string")))


def sanitise(docs: DataFrame, remove: float = 0.98, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, text) of every row with its spans masked, the longer of those that start together first.

    Matches become their kind in brackets; a term is generalised to [name] if it is capitalised and to [word]
    otherwise, and removed at a disclosure of `remove` or more.
    """
    found = find(docs, id_col=id_col, text_col=text_col, **options).dropDuplicates(["key"]).drop("doc_id")
    fixed = lambda k: F.transform(k, lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("stop"), F.lit(f"[{k}]").alias("put")))
    coarse = lambda m: F.when(m["disclosure"] >= remove, "").when(m["value"].rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")
    spans = F.array_sort(F.concat(*[fixed(k) for k in KINDS], F.transform("term", lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("stop"), coarse(m).alias("put")))))
    rows = merged(keyed(docs, id_col, text_col), found.select("key", spans.alias("spans")), "key")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def put(acc, s):
        more = F.array_append(F.array_append(acc["parts"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"])), s["put"])
        return F.when(s["start"] >= acc["at"], F.struct((-s["stop"]).alias("at"), more.alias("parts"))).otherwise(acc)

    done = F.aggregate("spans", start, put, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring("text", acc["at"] + 1, F.length("text"))))
    return rows.select("doc_id", F.when(F.size("spans") > 0, done).otherwise(F.col("text")).alias("text"))


def _sql_matches(kind: str, pattern: str, test: str) -> str:
    return f"""{kind}_all AS (SELECT r, unnest(regexp_extract_all(text, '{pattern}')) AS value, unnest(regexp_split_to_array(text, '{pattern}')[:-2]) AS before, unnest(regexp_split_to_array(text, '{pattern}')[2:]) AS behind,
  unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS i FROM t),
{kind}_m AS (SELECT r, '{kind}' AS kind, value, before, behind, s - length(value) AS start, s AS stop FROM (SELECT *, CAST(sum(length(before) + length(value)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS s FROM {kind}_all) WHERE {test})"""


def oracle() -> str:
    """The same in SQL, with the patterns as they are usually written."""
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    plain = r"regexp_replace(value, '[^0-9]', '', 'g')"
    luhn_sql = f"length({plain}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length({plain})), lambda i: CASE WHEN i % 2 = 0 THEN CAST({plain}[length({plain}) - i] AS INT) ELSE (CAST({plain}[length({plain}) - i] AS INT) * 2) // 10 + (CAST({plain}[length({plain}) - i] AS INT) * 2) % 10 END)) % 10 = 0"
    kinds = [
        _sql_matches("email", email, "TRUE"),
        _sql_matches("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(value, '.'), lambda p: CAST(p AS HUGEINT))) <= 255"),
        _sql_matches("card", r"[0-9]([\x20-]?[0-9])+", luhn_sql),
        _sql_matches("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({plain}) BETWEEN 8 AND 15"),
    ]
    union = " UNION ALL ".join(f"SELECT * FROM {k}_m" for k in KINDS)
    of = lambda k: f"count(*) FILTER (WHERE kind = '{k}')"
    rank = "CASE kind WHEN 'email' THEN 1 WHEN 'ip' THEN 2 WHEN 'card' THEN 3 WHEN 'phone' THEN 4 ELSE 5 END"
    listing = f"string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY {rank}, start)"
    return f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{", ".join(kinds)},
base AS MATERIALIZED ({union}),
about AS MATERIALIZED (SELECT r, text, kind || ':' || CASE kind WHEN 'email' THEN lower(value) WHEN 'ip' THEN value ELSE {plain} END AS entity,
  CASE WHEN length(before) > 120 THEN regexp_replace(right(before, 120), '^[^\\x20\\x09-\\x0D]+', '') ELSE before END || ' ' || CASE WHEN length(behind) > 120 THEN regexp_replace(left(behind, 120), '[^\\x20\\x09-\\x0D]+$', '') ELSE behind END AS near
  FROM base JOIN t USING (r)),
clean AS MATERIALIZED (SELECT r, text, doc_id, array_to_string(list_transform(list_zip(regexp_split_to_array(text, '{email}'), list_append(list_transform(regexp_extract_all(text, '{email}'), lambda e: repeat('0', length(e))), '')), lambda z: z[1] || z[2]), '') AS s FROM t),
held AS MATERIALIZED (SELECT DISTINCT text, unnest(regexp_extract_all(lower(s), '\\p{{L}}{{3,}}')) AS term FROM clean),
pairs AS MATERIALIZED (SELECT DISTINCT entity, text, near, unnest(regexp_extract_all(lower(near), '\\p{{L}}{{3,}}')) AS term FROM about),
often AS (SELECT entity, term FROM pairs GROUP BY ALL HAVING count(DISTINCT near) >= 3),
n_e AS (SELECT entity, count(DISTINCT text) AS n_e FROM about GROUP BY entity),
n_t AS (SELECT term, count(*) AS n_t FROM held GROUP BY term),
n_both AS (SELECT entity, term, count(DISTINCT text) AS n_both FROM pairs JOIN often USING (entity, term) JOIN held USING (text, term) GROUP BY ALL),
flagged AS MATERIALIZED (SELECT term, max(1 + log2(n_both / n_t) / log2((SELECT count(DISTINCT text) FROM t) / n_e)) AS d FROM n_both JOIN n_e USING (entity) JOIN n_t USING (term) WHERE n_e < (SELECT count(DISTINCT text) FROM t) GROUP BY term HAVING d >= 0.9),
words AS (SELECT r, unnest(regexp_extract_all(s, '\\p{{L}}{{3,}}')) AS value, unnest(regexp_split_to_array(s, '\\p{{L}}{{3,}}')[:-2]) AS before, unnest(range(len(regexp_extract_all(s, '\\p{{L}}{{3,}}')))) AS i FROM clean WHERE text IN (SELECT text FROM held JOIN flagged USING (term))),
term_m AS (SELECT r, 'term' AS kind, s - length(value) AS start, s AS stop FROM (SELECT *, CAST(sum(length(before) + length(value)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS s FROM words) WHERE lower(value) IN (SELECT term FROM flagged)),
every AS (SELECT r, kind, start, stop FROM base UNION ALL SELECT * FROM term_m)
SELECT any_value(doc_id) AS doc_id, {of("email")} AS n_email, {of("ip")} AS n_ip, {of("card")} AS n_card, {of("phone")} AS n_phone,
  sha256(coalesce({listing} FILTER (WHERE kind <> 'term'), '')) AS base_sha256, coalesce({listing}, '') AS spans
FROM t LEFT JOIN every USING (r) GROUP BY r"""


ORACLE = oracle()
