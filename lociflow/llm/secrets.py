r"""Secret scan: fixed patterns, then sliding-window Shannon entropy over candidate strings, in DataFrame functions only.

Positions come from the text itself: split() gives the gaps between a pattern's matches and regexp_extract_all() the
matches, so running sums of their lengths, by blocks of matches and then over the blocks, give each match's start in
code points.

A candidate is a run of at least MIN_RUN characters of `[A-Za-z0-9+/_=-]`, without any `=` in front. Its class (hex, letters and digits, or
base64 with its symbols) sets the entropy that a window must reach; runs without a digit or without a letter have no
class and are passed over. The window's entropy is log2(W) - S / W with S the sum of n * log2(n) over its character
counts n. S and the counts are carried from window to window: a step takes the leaving character out of both and puts
the entering one in.

SQL_ALLOW holds the allow-list for engines whose patterns can't look ahead. Edge cases: a null text counts as empty; it and texts without matches give 0 spans, the SHA-256 of the empty string
and an empty `spans`. Texts of any length are read whole. Repeated rows are scanned alike. Extra columns are kept;
those with the name of a result column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in their order, with pattern, group whose length counts, and that least length.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16))
# The same matches, found faster: a run of hex digits or of capitals is one match, so short ones need not be matched.
FAST = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
MIN_RUN = 20
RUN = rf"[A-Za-z0-9+/_-][A-Za-z0-9+/_=-]{{{MIN_RUN - 1},}}"
#: Bits a window of WINDOW characters must reach, by class.
WINDOW = 20
BITS = {"hex": 3.0, "alnum": 3.6, "base64": 3.9}
#: A part of a path between slashes: words (one case, or capitals in front), each with up to eight digits behind it.
PART = r"([A-Z]?[a-z]+([A-Z][a-z]+)*|[A-Z]+)?[0-9]{0,8}"
SEGMENT = rf"{PART}([_-]{PART})*"
# Candidates that are no secrets: identifiers, placeholders, counted-up digits, file paths and names. The last two repeat
# groups, for which Java's matcher recurses, once a part: allowed() tests the parts instead.
ALLOW = (
    r"^[/_+-]*[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|dummy|changeme|your[_-]|xxxx",
    r"0123456789|1234567890|abcdefghij",
    rf"^(?=.*/.*/)([A-Za-z_-]+=)?{SEGMENT}(/{SEGMENT})*$",
    r"^[/_+-]*[A-Za-z]+([_-][A-Za-z]+)*[_-]?[0-9]{0,4}$",
)
# The same with two slashes asked for apart: (pattern, and one that must also match).
SQL_ALLOW = (*((p, "") for p in (*ALLOW[:3], ALLOW[4])), (ALLOW[3].replace("(?=.*/.*/)", ""), "/.*/"))
RESULT = ("n_assign", "n_access", "n_hex", "base_spans", "entropy_spans")


SPANS = "array<struct<at:int,until:int,m:string>>"
#: Matches whose places are summed up in one go: appending to an array copies it, so long ones are built from blocks.
RUN_OF = 64
#: The characters of candidates, in the order of their counts.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def matches(text: Column, pattern: str) -> Column:
    """Array of structs (at, until, m): each leftmost match of a pattern, with its place in code points."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1).alias("m"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        until = at + F.coalesce(F.length(x["m"]), F.lit(0))
        return F.struct(until.alias("at"), F.concat(acc["all"], F.array(F.struct(at.alias("at"), until.alias("until"), x["m"].alias("m")))).alias("all"))

    none = F.expr(f"cast(array() as {SPANS})")
    some = lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("all")), step)

    def by_block(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN_OF).cast("int")), lambda k: some(F.slice(pairs, k * RUN_OF + 1, F.lit(RUN_OF))))
        return bound(blocks, moved)

    def moved(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        by = lambda x, n: F.struct((x["at"] + n).alias("at"), (x["until"] + n).alias("until"), x["m"].alias("m"))
        return bound(starts, lambda n: F.flatten(F.transform(blocks, lambda b, k: F.transform(b["all"], lambda x: by(x, F.get(n, k))))))

    found = bound(pairs, lambda p: F.when(F.size(p) <= RUN_OF, some(p)["all"]).otherwise(by_block(p)))
    return F.when(text.rlike(pattern), F.filter(found, lambda x: x["m"].isNotNull())).otherwise(none)


def bound(value: Column, use) -> Column:
    """use(value), with value computed once although use reads it in a lambda of its own."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def entropy_peak(chars: Column, window: int = WINDOW) -> Column:
    """The highest entropy, in bits, of the windows over an array of characters at least as long as a window."""
    xlogx = lambda n: F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    changed = lambda counts, k, by: F.concat(F.slice(counts, F.lit(1), k - 1), F.array(F.get(counts, k - 1) + by), F.slice(counts, k + 1, F.lit(len(ALPHABET))))

    def over(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            full = i >= window
            old, new = F.get(codes, i - window), F.get(codes, i)
            leaving = F.get(acc["counts"], old - 1)
            left = F.when(full, changed(acc["counts"], old, -1)).otherwise(acc["counts"])

            def entered(counts: Column) -> Column:
                entering = F.get(counts, new - 1)
                s = acc["s"] - F.when(full, xlogx(leaving) - xlogx(leaving - 1)).otherwise(0.0) + xlogx(entering + 1) - xlogx(entering)
                return bound(s, lambda s: F.struct(s.alias("s"), F.greatest(acc["peak"], F.when(i >= window - 1, F.log2(F.lit(float(window))) - s / window).otherwise(0.0)).alias("peak"), changed(counts, new, 1).alias("counts")))

            return bound(left, entered)

        start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("peak"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: acc["peak"])

    return bound(F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c)), over)


def _is_part(part: Column) -> Column:
    """PART: letters and up to eight digits; the letters all capitals, or each capital with a small letter behind it."""
    return part.rlike("^[A-Za-z]*[0-9]{0,8}$") & (part.rlike("^[A-Z]*[0-9]*$") | ~part.rlike("[A-Z]([A-Z0-9]|$)"))


def allowed(m: Column) -> Column:
    """Whether a candidate is on the allow-list, for candidates of any length."""
    found = F.lit(False)
    for pattern in ALLOW[:3]:
        found = found | m.rlike(pattern)
    path = (F.size(F.split(m, "/")) > 2) & F.forall(F.split(F.regexp_replace(m, "^[A-Za-z_-]+=", ""), "[/_-]"), _is_part)
    words = F.regexp_replace(F.regexp_replace(m, "^[/_+-]+", ""), "[_-]?[0-9]{0,4}$", "")
    name = words.rlike("^[A-Za-z]([A-Za-z_-]*[A-Za-z])?$") & ~words.rlike("[_-]{2}")
    return found | path | name


def is_secret(m: Column) -> Column:
    mixed = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    bits = F.when(m.rlike("^[0-9a-fA-F]+$"), BITS["hex"]).when(m.rlike("^[A-Za-z0-9]+$"), BITS["alnum"]).otherwise(BITS["base64"])
    return F.when(mixed & ~allowed(m), bound(F.split(m, ""), entropy_peak) >= bits).otherwise(False)


def base_spans(text: Column, k: int, name: str, pattern: str, group: int, least: int) -> Column:
    long_enough = lambda x: F.length(F.regexp_extract(x["m"], pattern, group) if group else x["m"]) >= least
    kept = F.filter(matches(text, FAST.get(name, pattern)), long_enough)
    return F.transform(kept, lambda x: F.struct(x["at"].alias("at"), F.lit(k).alias("kind"), x["until"].alias("until"), F.lit(name).alias("name")))


def scan(docs: DataFrame) -> DataFrame:
    """docs with the counts of the base kinds, base_spans and entropy_spans: arrays of (at, kind, until, name), code
    points, until exclusive, sorted. Entropy spans within a base span are left out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = {}
    for k, (name, pattern, group, least) in enumerate(KINDS):
        kinds[name] = base_spans(text, k, name, pattern, group, least)
    out = docs.drop(*RESULT).withColumns({f"__lf_{n}": c for n, c in kinds.items()} | {"__lf_runs": F.filter(matches(text, RUN), lambda x: is_secret(x["m"]))})
    base = F.array_sort(F.concat(*[f"__lf_{n}" for n in kinds]))
    out = out.withColumn("base_spans", base)
    added = F.filter("__lf_runs", lambda x: ~F.exists("base_spans", lambda b: (b["at"] <= x["at"]) & (x["until"] <= b["until"])))
    added = F.transform(added, lambda x: F.struct(x["at"].alias("at"), F.lit(len(KINDS)).alias("kind"), x["until"].alias("until"), F.lit("entropy").alias("name")))
    out = out.withColumn("entropy_spans", added).withColumns({f"n_{n}": F.size(f"__lf_{n}").cast("long") for n in kinds})
    return out.drop(*[f"__lf_{n}" for n in kinds], "__lf_runs")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["at"].cast("string"), s["until"].cast("string"))), ",")


def sql() -> str:
    """The query in DuckDB's SQL: matches and gaps unnested side by side, places by window sums, and the entropy of
    each window from its characters grouped anew."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = [*((k, name, p) for k, (name, p, _, _) in enumerate(KINDS)), (len(KINDS), "entropy", RUN)]
    found = " UNION ALL ".join(
        f"""SELECT rid, {k} AS kind, '{name}' AS name, unnest(string_split_regex(t, {quoted(p)})) AS gap, unnest(regexp_extract_all(t, {quoted(p)})) AS m, generate_subscripts(string_split_regex(t, {quoted(p)}), 1) AS i FROM d"""
        for k, name, p in kinds
    )
    long_enough = " OR ".join(f"kind = {k} AND length({f'regexp_extract(m, {quoted(p)}, {g})' if g else 'm'}) >= {n}" for k, (_, p, g, n) in enumerate(KINDS))
    allowed = " OR ".join(f"(regexp_matches(m, {quoted(p)})" + (f" AND regexp_matches(m, {quoted(q)}))" if q else ")") for p, q in SQL_ALLOW)
    spans = "coalesce(string_agg(name || ':' || pos || ':' || until, ',' ORDER BY pos, kind, until){}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
placed AS (SELECT *, (sum(length(gap)) OVER w + sum(coalesce(length(m), 0)) OVER w)::BIGINT AS until FROM found WINDOW w AS (PARTITION BY rid, kind ORDER BY i)),
matched AS (SELECT rid, kind, name, m, until - length(m) AS pos, until FROM placed WHERE m IS NOT NULL),
base AS (SELECT * FROM matched WHERE {long_enough}),
runs AS (SELECT *, CASE WHEN regexp_matches(m, '^[0-9a-fA-F]+$') THEN {BITS["hex"]}::DOUBLE WHEN regexp_matches(m, '^[A-Za-z0-9]+$') THEN {BITS["alnum"]}::DOUBLE ELSE {BITS["base64"]}::DOUBLE END AS bits FROM matched
  WHERE kind = {len(KINDS)} AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT ({allowed})),
cuts AS (SELECT rid, pos, unnest(range(1, length(m) - {WINDOW - 2})) AS w, m FROM runs),
letters AS (SELECT rid, pos, w, unnest(string_split(substr(m, w, {WINDOW}), '')) AS c FROM cuts),
sums AS (SELECT rid, pos, w, sum(n * log2(n)) AS s FROM (SELECT rid, pos, w, c, count(*) AS n FROM letters GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
peaks AS (SELECT rid, pos, max(log2({WINDOW}) - s / {WINDOW}::DOUBLE) AS peak FROM sums GROUP BY 1, 2),
secret AS (SELECT r.* FROM runs r JOIN peaks p ON r.rid = p.rid AND r.pos = p.pos WHERE p.peak >= r.bits
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.pos <= r.pos AND r.until <= b.until)),
spans AS (SELECT rid, kind, name, pos, until FROM base UNION ALL SELECT rid, kind, name, pos, until FROM secret),
whole AS (SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, {spans.format(f" FILTER (kind < {len(KINDS)})")} AS base, {spans.format("")} AS spans FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN whole USING (rid)"""
