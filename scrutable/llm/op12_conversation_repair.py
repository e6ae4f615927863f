"""Conversation structure repair by a dynamic programme shared along a trie of signatures.

A conversation's rows, ordered by turn, become a signature: one letter a row for what its role begins with
(s, u, a or another) and its fault (none, truncated, blank, duplicate). Cheapest edits depend on the signature
alone. The distinct signatures of the corpus are sorted; walking them in order is walking their prefix trie in
depth, so a task keeps one path of layers, goes back to the prefix that two neighbours share, and works out a
layer (the least cost of each state after a row) once for all signatures below that prefix. At a signature's
end the answer is read back along the layers. Conversations get theirs by a shuffled join on the signature.

The edits bring a conversation into the form "an optional system row, then pairs of user and assistant, or
nothing": Keep (0), Rerole to user or assistant (3), Delete (4; the only way for blank and duplicate rows),
Insert an empty row of user or assistant (3); a truncated row that stays costs 3 more. Of equally cheap edits
the string of their initials that comes first in ASCII is taken.

Only hashes and fault marks of texts take part in finding signatures, cut by ranges of (conversation, turn):
one conversation with a third of all rows is spread over many tasks, equal rows are counted before they are
shuffled, and no join is on a hot key. Texts are shuffled once, beside the edits, and stream through one task
a conversation, row by row, since a repaired text is one stream; memory is that of a batch. A conversation's
signature and edits, a byte a row, are one cell each, as in the result.

Null roles and texts count as one space. Rows without conv_id are one conversation; null turns come first.
Rows of one turn are in order of role, then of their text's SHA-256; repeated rows are duplicates of the
first. Empty tables give no rows. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, merged, ship

WHITE = " \t\n\x0b\x0c\r"
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
CLASSES = "sua*"
#: states: nothing yet, after system, after user, after assistant; from which a user or an assistant may follow
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
ENDS = (EMPTY, ASSISTANT)
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
NEVER = 1 << 60
KEYS = ["conv_id", "turn", "role", "h"]


def letter(kind: int, fault: int) -> str:
    return chr(97 + 4 * kind + fault)


def steps(symbol: str) -> list[tuple[str, int, int, int]]:
    """(initial, from, to, cost) of every edit of a row with this letter, in ASCII order of initials."""
    kind, fault = divmod(ord(symbol) - 97, 4)
    out = [("D", q, q, DELETE) for q in range(4)]
    if fault in (FINE, TRUNCATED):
        more = CUT_SHORT if fault == TRUNCATED else 0
        keeps = {0: [(EMPTY, SYSTEM)], 1: [(q, USER) for q in (EMPTY, SYSTEM, ASSISTANT)], 2: [(USER, ASSISTANT)], 3: []}[kind]
        out += [("K", p, q, more) for p, q in keeps]
        out += [("R", p, q, REROLE + more) for p, q in FOLLOWS.items()]
    return out


STEPS = {letter(k, f): steps(letter(k, f)) for k in range(4) for f in range(4)}


def closed(layer: list[int]) -> tuple[int, ...]:
    """Least costs of the states when rows may be inserted here."""
    layer[USER] = min(layer[USER], INSERT + min(layer[EMPTY], layer[SYSTEM], layer[ASSISTANT]))
    layer[ASSISTANT] = min(layer[ASSISTANT], INSERT + layer[USER])
    return tuple(layer)


FIRST = closed([0, NEVER, NEVER, NEVER])


def after(layer: tuple[int, ...], symbol: str) -> tuple[int, ...]:
    out = [NEVER] * 4
    for _, p, q, cost in STEPS[symbol]:
        out[q] = min(out[q], layer[p] + cost)
    return closed(out)


def read_back(signature: str, layers: list[tuple[int, ...]]) -> tuple[int, str]:
    """Least cost, and of the cheapest edits the initials that are least in ASCII.

    Backwards, the states that lie on a cheapest way; forwards, the least initial that stays on one.
    """
    n = len(signature)
    cost = min(layers[n][q] for q in ENDS)
    on = [set() for _ in range(n + 1)]
    on[n] = {q for q in ENDS if layers[n][q] == cost}
    for i in range(n, -1, -1):
        for _ in range(2):
            on[i] |= {p for p, q in FOLLOWS.items() if q in on[i] and layers[i][p] + INSERT == layers[i][q]}
        if i:
            on[i - 1] = {p for _, p, q, c in STEPS[signature[i - 1]] if q in on[i] and layers[i - 1][p] + c == layers[i][q]}
    i, state, out = 0, EMPTY, []
    while i < n or state not in ENDS or layers[n][state] != cost:
        ways = [("I", FOLLOWS[state], INSERT, 0)]
        if i < n:
            ways += [(e, q, c, 1) for e, p, q, c in STEPS[signature[i]] if p == state]
        e, state, i = min((e, q, i + more) for e, q, c, more in ways if q in on[i + more] and layers[i][state] + c == layers[i + more][q])
        out.append(e)
    return cost, "".join(out)


def solve(signatures) -> list:
    """(signature, cost, audit) of sorted signatures, with the layers of a shared prefix worked out once."""
    path, before = [FIRST], ""
    for sig in signatures:
        shared = len(os.path.commonprefix((before, sig)))
        del path[shared + 1 :]
        for symbol in sig[shared:]:
            path.append(after(path[-1], symbol))
        yield sig, *read_back(sig, path)
        before = sig


def counts(sig: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours of which the roles must not follow each other."""
    of = [divmod(ord(c) - 97, 4) for c in sig]
    by = [sum(f == fault for _, f in of) for fault in (BLANK, DUPLICATE, TRUNCATED)]
    roles = "".join(CLASSES[k] for k, _ in of)
    return *by, sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))


ANSWER = "sig string, cost long, audit string, blank long, duplicate long, truncated long, illegal long"


def _answers(batches):
    names, rows = [x.split()[0] for x in ANSWER.split(", ")], []
    for sig, cost, audit in solve(s for b in batches for s in b.column("sig").to_pylist()):
        rows.append(dict(zip(names, (sig, cost, audit, *counts(sig)), strict=True)))
        if len(rows) >= 2000:
            yield pa.RecordBatch.from_pylist(rows)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows)


def _pieces(batches):
    """(conv_id, part, sig): the letters of each conversation's rows inside this range."""
    key, part, runs, out = None, None, [], []
    for batch in batches:
        for conv, p, run in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "run")), strict=True):
            if runs and conv != key:
                out.append({"conv_id": key, "part": part, "sig": "".join(runs)})
                runs = []
            key, part = conv, p
            runs.append(run)
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("sig", pa.string())]))
            out = []
    if runs:
        yield pa.RecordBatch.from_pylist([{"conv_id": key, "part": part, "sig": "".join(runs)}], pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("sig", pa.string())]))


def plain(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, h) with null roles and texts as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text")).withColumn("h", F.unhex(F.sha2("text", 256)))


def signatures(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, sig, gaps) of each conversation, and of those in `ids` that have no rows."""
    kept = F.rtrim(F.col("text"), F.lit(WHITE))
    marked = plain(rows).select(*KEYS, (kept == "").alias("blank"), (~F.right(kept, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    held = cut(marked.groupBy(*KEYS).agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")))
    early = F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("at")
    first = held.where("NOT blank").groupBy("conv_id", "role", "h").agg(early).select("conv_id", F.col("at.turn").alias("turn"), "role", "h", F.lit(True).alias("first"))
    both = held.withColumn("first", F.lit(False)).unionByName(first, allowMissingColumns=True)
    once = both.groupBy(*KEYS).agg(F.max("n").alias("n"), F.max("first").alias("first"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    begins = F.left("role", F.lit(1))
    kind = F.when(begins == "s", 0).when(begins == "u", 1).when(begins == "a", 2).otherwise(3)
    name = lambda fault: F.char(F.lit(97) + kind * 4 + fault)
    own = F.when(F.col("cut"), name(TRUNCATED)).otherwise(name(FINE))
    n = F.col("n").cast("int")
    run = F.when(F.col("blank"), F.repeat(name(BLANK), n)).when(F.col("first"), F.concat(own, F.repeat(name(DUPLICATE), n - 1))).otherwise(F.repeat(name(DUPLICATE), n))
    ranged = once.select(*KEYS, run.alias("run")).repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    pieces = ranged.select("conv_id", F.spark_partition_id().alias("part"), "run").mapInArrow(_pieces, "conv_id long, part int, sig string")
    turns = held.select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    every = pieces.unionByName(turns, allowMissingColumns=True)
    if ids is not None:
        every = every.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), allowMissingColumns=True)
    piece = F.when(F.col("sig").isNotNull(), F.struct("part", "sig"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["sig"]), "")
    return every.groupBy("conv_id").agg(whole.alias("sig"), F.coalesce(F.max("gaps"), F.lit(0)).cast("long").alias("gaps"))


def plan(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): the cheapest edits of each conversation."""
    ship(rows.sparkSession)
    of = cut(signatures(rows, ids))
    distinct = of.select("sig").distinct().repartitionByRange("sig").sortWithinPartitions("sig")
    answers = distinct.mapInArrow(_answers, ANSWER)
    return cut(merged(of, answers, "sig").drop("sig"))


class _Repair:
    """A conversation's edits, applied to its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, EMPTY

    def inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = FOLLOWS[self.state]
            yield "I", ROLE[self.state], ""

    def row(self, role: str, text: str):
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = FOLLOWS[self.state]
            role = ROLE[self.state]
        elif edit == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        if edit != "D":
            yield edit, role, text


def _edited(batches):
    """For each conversation its header, then (edit, role, text) of its repaired rows, then None."""
    now = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if now is not None:
                    yield from now.inserted()
                    yield None
                now = _Repair(row["audit"])
                yield row
            else:
                yield from now.row(row["role"], row["text"])
    if now is not None:
        yield from now.inserted()
        yield None


def _rows(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    conv, position, out, size = None, 0, [], 0
    for x in _edited(batches):
        if isinstance(x, dict):
            conv, position = x["conv_id"], 0
        elif x is not None:
            out.append({"conv_id": conv, "position": position, "edit": x[0], "role": x[1], "text": x[2]})
            position, size = position + 1, size + len(x[2])
            if len(out) >= 1000 or size > 1 << 22:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summaries(batches):
    names, out, header, digest, some = [x.split()[0] for x in SUMMARY.split(", ")], [], None, None, False
    schema = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in names])
    for x in _edited(batches):
        if isinstance(x, dict):
            header, digest, some = x, hashlib.sha256(), False
        elif x is None:
            out.append({c: header[c] for c in names[:-1]} | {"repaired_sha256": digest.hexdigest()})
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        else:
            digest.update(f"{chr(10) if some else ''}{x[1]}:{x[2]}".encode())
            some = True
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _beside(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Edits and texts of each conversation in one task, the edits first, the rows in order."""
    texts = plain(rows).withColumn("kind", F.lit(1))
    both = texts.unionByName(planned.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    names = [c.split()[0] for c in SUMMARY.split(", ")[1:-1]]
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "h").select("conv_id", "kind", "role", "text", *names)


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired rows of every conversation, edits K, R or I."""
    return _beside(rows, plan(rows, ids)).mapInArrow(_rows, "conv_id long, position long, edit string, role string, text string")


def summarise(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Faults, cost, edits and the repaired text's SHA-256 of every conversation; without rows zeros and nothing."""
    return _beside(rows, plan(rows, ids)).mapInArrow(_summaries, SUMMARY)


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults made by crc32(conv_id:turn) % 20: dropped, emptied, without stops, repeated, or all user."""
    given = plain(rows).drop("h")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = given.withColumn("hit", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1)))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _best(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def _add(state: str, cost: str, initial: str, line: str | None = None) -> str:
    told = f"list_append({state}.r, {line})" if line else f"{state}.r"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}', 'r': {told}}} END"


def oracle() -> str:
    """The same in SQL: a recursion over rows that carries cost, initials and lines of each state."""
    keep, stay = "NOT d.lost", "CASE WHEN d.cut THEN 3 ELSE 0 END"
    when = lambda test, way: f"CASE WHEN {test} THEN {way} END"
    fresh = lambda q: (when(f"{keep} AND left(d.role, 1) = 'u'", _add(q, stay, "K", "d.role || ':' || d.text")), when(keep, _add(q, f"3 + {stay}", "R", "'user:' || d.text")))
    user = _best(_add("p.u", "4", "D"), *fresh("p.z"), *fresh("p.s"), *fresh("p.a"))
    assistant = _best(_add("p.a", "4", "D"), when(f"{keep} AND left(d.role, 1) = 'a'", _add("p.u", stay, "K", "d.role || ':' || d.text")), when(keep, _add("p.u", f"3 + {stay}", "R", "'assistant:' || d.text")))
    system = _best(_add("p.s", "4", "D"), when(f"{keep} AND left(d.role, 1) = 's'", _add("p.z", stay, "K", "d.role || ':' || d.text")))
    put = lambda q, role: _add(q, "3", "I", f"'{role}:'")
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]))"
    return f"""WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), hit AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS hit FROM given
), damaged AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE hit <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged
), judged AS MATERIALIZED (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS ragged, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed
), rows_ AS MATERIALIZED (
  SELECT conv_id, i, role, text, blank OR again AS lost, ragged AS cut FROM judged
), dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}} AS z, {none} AS s, {{'c': CAST(3 AS BIGINT), 'a': 'I', 'r': ['user:']}} AS u, {{'c': CAST(6 AS BIGINT), 'a': 'II', 'r': ['user:', 'assistant:']}} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, z, s, u, {_best('a', put('u', 'assistant'))} FROM (SELECT conv_id, i, z, s, {_best('u', put('z', 'user'), put('s', 'user'), put('a', 'user'))} AS u, a FROM (
    SELECT p.conv_id, d.i, {_add('p.z', '4', 'D')} AS z, {system} AS s, {user} AS u, {assistant} AS a FROM dp p JOIN rows_ d ON d.conv_id IS NOT DISTINCT FROM p.conv_id AND d.i = p.i + 1))
), best AS (
  SELECT conv_id, {_best('z', 'a')} AS b FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
    count(*) FILTER (WHERE ragged AND NOT blank AND NOT again) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.c AS cost, b.a AS audit, sha256(array_to_string(b.r, chr(10))) AS repaired_sha256
FROM best LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM best.conv_id"""


ORACLE = oracle()
