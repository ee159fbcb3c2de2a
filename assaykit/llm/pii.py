"""Personal data in whole texts, with DataFrame and SQL functions only.

Base kinds are e-mail and IP addresses, card numbers and phone numbers by their patterns and checks. More spans come from
candidates: generators of high recall propose overlapping spans (spelled addresses, numbers and phone numbers without a plus sign, national
identifiers and account numbers, secrets), boosted trees judge each by its format and context, and a span is added if its calibrated
probability reaches ``precision`` and no base span overlaps it (but a secret may hold base spans).

Labels to learn from are votes that no tree sees as such: a candidate is right if it overlaps a base span, passes its kind's check
(``mod 97`` of an account number, the number ranges of an identifier, both signs of an address spelled out), or stands behind a word that announces
it and has the digits for it. The trees learn on at most ``most`` different texts, chosen by hash; isotonic regression per kind turns their scores into
probabilities, counted over the candidates of all documents (at most 101 rows a kind reach the driver). Fitted trees are SQL
expressions, so a text is read once more and nothing but these counts is shuffled. Equal texts get equal spans.

Positions are code points, ends exclusive. Null and empty texts have no spans, repeated rows have the same ones, other columns are
left out. Patterns do not go back over what they have read, so long runs take time in proportion to their length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm import boosted
from assaykit.llm.common import texts
from assaykit.session import stored

MOST = 20_000
PRECISION = 0.9
KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: Same matches as the plain patterns: a match begins where a run begins or where the last match ended.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
CANDIDATES = {
    "maybe_phone": r"(?<![0-9A-Za-z])(?:\([0-9]{2,5}\)[ ]?)?[0-9]{2,5}(?:[ ./-][0-9]{2,5}){1,5}(?![0-9A-Za-z])",
    "maybe_number": r"(?<![0-9A-Za-z])[0-9]{6,19}(?![0-9A-Za-z])",
    "maybe_email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]{{1,64}}+ ?(?:\(at\)|\[at\]| at |@) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z]{{2,12}})++",
    "maybe_id": r"(?<![0-9A-Za-z])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z])",
    "maybe_secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+",
}
BEFORE, AFTER = 24, 8
CONTEXT = r"(?i)(?:phone|tel|call|fax|mobile|mail|contact|card|visa|credit|account|iban|ssn|address|reach|write)\W{0,4}\w{0,8}\W{0,3}$"
SECRET = r"(?i)(?:pass\w*|token|key|secret|hash|id|version|v|no|nr)\W{0,4}\w{0,40}$"
ANNOUNCED = r"(?i)(?:phone|tel|call|fax|mobile|mail|contact|reach|write)\W{0,4}$"
SECRET_NAME = r"(?i)(?:pass(?:word|wd|phrase)?|token|secret|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\s{0,2}[:=]\s{0,2}[\"']?$"
FEATURES = ("digits", "length", "spaces", "hyphens", "dots", "brackets", "letters", "groups", "longest", "at", "left", "right", "context",
            "secret")


#: What a text must contain for any match of a pattern; texts without it are not searched.
NEEDS = {"email": "at", "ip": "digit", "card": "digit", "phone": "plus", "maybe_phone": "digit", "maybe_number": "digit",
         "maybe_email": "spelled", "maybe_id": "digit", "maybe_secret": "digit"}


def with_matches(docs: DataFrame, patterns: dict[str, str], prefix: str) -> DataFrame:
    """A column for each pattern: start, end and text of its matches, left to right.

    The lengths of the pieces between matches give the places.
    """
    text = F.col("text")
    needs = {"at": text.contains("@"), "plus": text.contains("+"), "digit": F.col("has_digit"),
             "spelled": text.contains("@") | text.contains("(at)") | text.contains("[at]") | text.contains(" at ")}
    none = F.array().cast("array<string>")
    docs = docs.withColumns({f"_{name}": F.when(needs[NEEDS[name]], F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
                             .otherwise(none) for name, pattern in patterns.items()})

    def placed(name: str, pattern: str) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))
        pairs = F.arrays_zip(F.col(f"_{name}").alias("m"), F.slice(F.split(text, pattern, -1), 1, F.size(f"_{name}")).alias("b"))

        def take(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["b"])
            end = start + F.length(x["m"])
            return F.struct(end.alias("at"), F.array_append(
                acc["out"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text"))).alias("out"))
        return F.when(F.size(f"_{name}") > 0, F.aggregate(pairs, begin, take)["out"]).otherwise(begin["out"])

    return (docs.withColumns({f"{prefix}{name}": placed(name, pattern) for name, pattern in patterns.items()})
            .drop(*(f"_{name}" for name in patterns)))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Every second digit from the right doubled; the digit sums add up to a multiple of ten."""
    value = lambda i: F.substring(F.reverse(number), i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))
    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0),
                        lambda acc, i: acc + F.when(i % 2 == 0, doubled(i)).otherwise(value(i)))
    return total % 10 == 0


def valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return text.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits(text)).between(12, 19) & luhn(digits(text))
    if kind == "phone":
        return F.length(digits(text)).between(9, 15)
    return F.lit(True)


def with_base(docs: DataFrame) -> DataFrame:
    """A column of spans for each base kind: the matches that pass their check."""
    def passing(kind: str) -> Column:
        return F.filter(f"all_{kind}", lambda x: valid(kind, x["text"])).alias(kind)

    docs = with_matches(docs.withColumn("has_digit", F.col("text").rlike("[0-9]")), BASE, "all_")
    return docs.select("doc_id", "text", "has_digit", *map(passing, KINDS))


def overlaps(span: Column, spans: Column) -> Column:
    return F.exists(spans, lambda x: (x["start"] < span["end"]) & (span["start"] < x["end"]))


def count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def before_of(span: Column, text: Column) -> Column:
    from_ = F.greatest(span["start"] - BEFORE, F.lit(0))
    return F.substring(text, from_ + 1, span["start"] - from_)


def account_number(text: Column) -> Column:
    """Whether the remainder by 97 is 1, the first four characters moved to the end and letters read as 10 to 35."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0),
                       lambda acc, c: (F.when(c.rlike("[0-9]"), acc * 10).otherwise(acc * 100) + value(c)) % 97)
    return F.length(plain).between(15, 34) & (rest == 1)


def vote(kind: str, span: Column, text: Column) -> Column:
    """Whether the check of a generator's kind, or the word before it together with its digits, says that a span is right."""
    s, before = span["text"], before_of(span, text)
    n = F.length(digits(s))
    if kind == "maybe_email":
        return s.rlike(r"@|\(at\)|\[at\]") | (s.rlike(" at ") & s.rlike(r" dot |\(dot\)|\[dot\]")) | before.rlike(ANNOUNCED)
    if kind == "maybe_id":
        ranges = s.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
        return F.when(s.rlike("^[0-9]"), ranges).otherwise(account_number(s))
    if kind == "maybe_secret":
        return before.rlike(SECRET_NAME) & (n >= 2) & s.rlike("[A-Za-z]")
    return before.rlike(ANNOUNCED) & n.between(7, 15)


def features(span: Column, text: Column) -> Column:
    """Array of FEATURES of a span, without a plus sign before it or a check digit in it."""
    s = span["text"]
    before = F.regexp_replace(before_of(span, text), r"[ (+]+$", " ")
    after = F.substring(text, span["end"] + 1, F.lit(AFTER))
    parts = F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0))
    values = (
        F.length(digits(s)), F.length(s), count_of(s, " "), count_of(s, "-"), count_of(s, "\\."), count_of(s, "[()]"),
        count_of(s, r"\p{L}"), F.size(parts), F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)), count_of(s, "@| at |at[)\\]]"),
        F.when(before.rlike(r"\p{L}$"), 1).when(before.rlike("[0-9]$"), 2).when(before.rlike(r"[^\p{L}0-9\s]$"), 3).otherwise(0),
        F.when(after.rlike(r"^\p{L}"), 1).when(after.rlike("^[0-9]"), 2).when(after.rlike(r"^[.,;:!?]?(?:\s|$)"), 0).otherwise(3),
        before.rlike(CONTEXT).cast("int"), before.rlike(SECRET).cast("int"))
    return F.array(*(v.cast("double") for v in values))


def candidates(docs: DataFrame) -> DataFrame:
    """Adds ``candidates``: generator, span, features and vote of every proposed span."""
    def proposed(name: str) -> Column:
        return F.transform(f"of_{name}", lambda x: F.struct(
            F.lit(name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"),
            features(x, F.col("text")).alias("f"), vote(name, x, F.col("text")).alias("vote")))

    docs = with_matches(docs, CANDIDATES, "of_")
    return docs.withColumn("candidates", F.concat(*map(proposed, CANDIDATES))).drop(*(f"of_{n}" for n in CANDIDATES))


def base_spans() -> Column:
    return F.concat(*(F.col(k) for k in KINDS))


def labelled(docs: DataFrame) -> DataFrame:
    """A row for each proposed span: its kind, label and features."""
    rows = candidates(with_base(docs)).withColumn("base", base_spans())
    # digits within a secret may pass for a number, which says nothing about the secret
    right = F.col("c.vote") | ((F.col("c.kind") != "maybe_secret") & overlaps(F.col("c"), F.col("base")))
    return (rows.select(F.explode("candidates").alias("c"), "base")
            .select("c.kind", right.cast("double").alias("label"),
                    F.pmod(F.xxhash64("c.text"), F.lit(2)).alias("side"),
                    *(F.col("c.f")[i].alias(name) for i, name in enumerate(FEATURES))))


def thresholds(steps: list, precision: float) -> dict[str, float]:
    """For each kind the least score whose calibrated probability reaches the target; 2 where none does.

    Isotonic regression over the steps of the score, ``steps`` being (kind, step, right, all).
    """
    out = {}
    for kind in CANDIDATES:
        pools: list[list[float]] = []  # first step, right, all; shares do not fall
        for row in sorted((r for r in steps if r.kind == kind), key=lambda r: r.step):
            pools.append([row.step, row.good, row.n])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                _, good, n = pools.pop()
                pools[-1][1:] = [pools[-1][1] + good, pools[-1][2] + n]
        out[kind] = next((first / 100 for first, good, n in pools if good >= precision * n), 2.0)
    return out


def fitted(docs: DataFrame, most: int, precision: float) -> tuple[list, dict[str, float]]:
    """Trees, and for each kind the least score that is accepted, calibrated on spans that the trees have not seen."""
    total = docs.count()
    share = min(1.0, most / total) if total else 1.0
    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = chosen.groupBy(F.xxhash64("text").alias("doc_id")).agg(F.any_value("text").alias("text"))  # different texts
    spans = stored(labelled(chosen), "spans")
    trees = boosted.fit(spans.where("side = 0").select("label", *FEATURES), FEATURES, rounds=10)
    if not trees:
        return [], {}
    raw = boosted.probability(trees, lambda i: F.col(FEATURES[i]))
    steps = (labelled(docs).where("side = 1").groupBy("kind", F.floor(raw * 100).cast("int").alias("step"))
             .agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect())  # at most 101 rows a kind
    return trees, thresholds(steps, precision)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, by start and then the order of the kinds."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def spans_of(docs: DataFrame, trees: list, least: dict[str, float]) -> DataFrame:
    """doc_id, base and added spans as arrays of (start, rank, end, kind), and text."""
    def ranked(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"),
                                                    F.lit(kind).alias("kind")))

    base = with_base(docs).withColumn("base", F.concat(*(ranked(i, kind) for i, kind in enumerate(KINDS))))
    if not trees:
        return base.withColumn("added", F.filter("base", lambda x: F.lit(False)))
    names = list(CANDIDATES)
    score = lambda x: boosted.probability(trees, lambda i: x["f"][i])
    judged = candidates(base).withColumn("judged", F.transform("candidates", lambda x: F.struct(
        x["start"].alias("start"), (len(KINDS) + F.array_position(F.array(*map(F.lit, names)), x["kind"]).cast("int")).alias("rank"),
        x["end"].alias("end"), x["kind"].alias("kind"), score(x).alias("score"))))
    accepted = F.create_map(*(F.lit(v) for kind in names for v in (kind, least[kind])))
    # a secret may hold a base span, but no added span cuts into one or lies within one
    clashing = lambda x: F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]) & ~(
        (x["kind"] == "maybe_secret") & (x["start"] <= y["start"]) & (y["end"] <= x["end"]) & (y["end"] - y["start"] < x["end"] - x["start"])))
    taken = F.filter("judged", lambda x: (F.floor(x["score"] * 100) >= F.round(accepted[x["kind"]] * 100)) & ~clashing(x))
    judged = judged.withColumn("taken", taken)
    # of overlapping proposals the longest stays, then the first generator's
    better = lambda x: F.exists("taken", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]) & (
        (y["end"] - y["start"] > x["end"] - x["start"])
        | ((y["end"] - y["start"] == x["end"] - x["start"]) & (F.struct(y["rank"], y["start"]) < F.struct(x["rank"], x["start"])))))
    return judged.withColumn("added", F.transform(F.filter("taken", lambda x: ~better(x)), lambda x: F.struct(
        x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))


def find(docs: DataFrame, most: int = MOST, precision: float = PRECISION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added (arrays of start, rank, end and kind) of every row."""
    docs = texts(docs, id_col, text_col)
    trees, least = fitted(docs, most, precision)
    return spans_of(docs, trees, least).select("doc_id", *KINDS, "base", "added")


def digest(spans: DataFrame) -> DataFrame:
    """Numbers of base spans, their SHA-256 and the list of all spans."""
    return spans.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"),
                        F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, spans: Callable[[DataFrame], DataFrame] = find, mark: str = "[{}]") -> DataFrame:
    """doc_id and text with every span replaced by its kind."""
    given = texts(docs)
    trees, least = fitted(given, MOST, PRECISION)
    rows = spans_of(given, trees, least).select("doc_id", "text", F.array_sort(F.concat("base", "added")).alias("spans"))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    before, after = mark.split("{}")
    done = F.aggregate("spans", begin, lambda acc, x: F.when(x["start"] >= acc["at"], F.struct(
        x["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]),
                                       F.lit(before), x["kind"], F.lit(after)).alias("out"))).otherwise(acc))
    rest = F.substring(F.col("text"), F.col("done.at") + 1, F.length("text"))
    return rows.withColumn("done", done).select("doc_id", F.concat("done.out", rest).alias("text"))
