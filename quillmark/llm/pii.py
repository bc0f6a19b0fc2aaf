"""PII by candidate gradient boosting, native: DataFrame and SQL functions only.

1. Base rules find e-mail addresses, IP addresses, card and phone numbers; what fails a rule's check (parts over
   255, Luhn, number of digits) is dropped without a retry. Base spans always stay.
2. High-recall generators propose overlapping spans: written-out addresses, any group of 7 to 19 digits, long
   mixed tokens, and values given to a secret-like name.
3. Boosted trees (spark.ml) score candidates by format and context features. They are trained in the session
   on candidates from seeded templates (``training_texts``: ``EXAMPLES`` rows, a documented bound; it needs no
   corpus rows), and compiled into one SQL expression, so that scoring is part of the same projection.
4. Thresholds a kind are calibrated on templates kept out of training: the larger of ``LEAST_PROBABILITY`` and
   the highest score of a negative. Candidates over the threshold that don't touch a base span are added, unless
   they overlap a likelier one (of equals the earlier, then the longer), whether or not that one is added itself.

Offsets count code points; ends are exclusive. A row costs time in proportion to its text, times its number of
matches only where offsets are taken. No shuffle, no Python on the executors.

The patterns are written possessively and start only at the start of a run (or where the last match ended), which
gives the base rules' leftmost matches without their quadratic retries on long runs.

Edge cases: a null or empty text has no spans (redaction keeps the null); repeated rows are judged each;
an empty table gives no rows; other columns are not read (``redact_pii`` passes them on).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, let, text_or_empty

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "secret")

WRITTEN = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(]at[\])]\x20?|\x20at\x20|\x20?@\x20?)[A-Za-z0-9-]++"
    r"(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++"
)
DIGITS = r"(?<![A-Za-z0-9])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,18}+(?![A-Za-z0-9])"
TOKEN = r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{16,}+"
NAMED = r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\x20?[=:]\x20?[\"']?[^\s\"',;]{6,}+"

EXAMPLES = 3000
LEAST_PROBABILITY = 0.8
SPAN = "struct<s:int,e:int,m:string>"


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as an array of (s, e, m)."""
    lengths = lambda gaps, ms: F.transform(ms, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("out"))

    none = F.struct(F.lit(0).alias("pos"), F.expr(f"CAST(array() AS array<{SPAN}>)").alias("out"))
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("ms"))
    return let(both, lambda z: F.aggregate(lengths(z["gaps"], z["ms"]), none, step, lambda acc: acc["out"]))


def _no_spans() -> Column:
    return F.expr(f"CAST(array() AS array<{SPAN}>)")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True for digits that pass the Luhn check."""

    def value(d: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    return let(digits, lambda d: F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + value(d, i)) % 10 == 0)


def _ip_ok(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the base rules, a kind each."""
    digit = text.rlike("[0-9]")
    of = lambda m: _digits(m["m"])
    card = lambda m: F.length(of(m)).between(16, 19) & luhn(of(m))
    return {
        "email": F.when(text.contains("@"), matches(text, EMAIL)).otherwise(_no_spans()),
        "ip": F.when(digit & text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), F.filter(matches(text, IP), lambda m: _ip_ok(m["m"]))).otherwise(_no_spans()),
        "card": F.when(digit, F.filter(matches(text, CARD), card)).otherwise(_no_spans()),
        "phone": F.when(text.contains("+"), F.filter(matches(text, PHONE), lambda m: F.length(of(m)).between(8, 15))).otherwise(_no_spans()),
    }


#: name -> feature of a candidate c (fields m, before, after), as numbers.
def _features(c: Column) -> dict[str, Column]:
    m, before = c["m"], F.lower(c["before"])
    count = lambda cls: F.length(F.regexp_replace(m, f"[^{cls}]", ""))
    said = lambda pattern: before.rlike(pattern)
    digits = _digits(m)
    return {
        "chars": F.length(m),
        "digits": F.length(digits),
        "upper": count("A-Z"),
        "lower": count("a-z"),
        "blanks": count(r"\x20"),
        "hyphens": count(r"\x2d"),
        "dots": count(r"\."),
        "slashes": count("/"),
        "changes": F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[A-Za-z]++", "a"), "[0-9]++", "0"), "[^a0]", "")),
        "groups_334": m.rlike(r"^\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}$"),
        "groups_4444": m.rlike(r"^[0-9]{4}(?:[\x20-]?[0-9]{4}){3}$"),
        "date_like": m.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}"),
        "at_dot": m.rlike(r"(?i)[\[(\x20@](?:at)?[\])\x20]?.*[\[(\x20.](?:dot)?[\])\x20]?"),
        "bracketed": m.rlike(r"(?i)[\[(]at[\])]|[\[(]dot[\])]"),
        "written_dot": m.rlike(r"(?i)\x20dot\x20"),
        "assigned": m.rlike(r"[A-Za-z][\"']?\x20?[=:]"),
        "known_prefix": m.rlike(r"^(?:AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[bp]-|eyJ)"),
        "luhn": F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False)),
        "said_phone": said(r"(?:phone|tel|call|fax|mobile|cell|whatsapp|telefon)[^a-z0-9]{0,3}\S{0,4}$"),
        "said_card": said(r"(?:card|visa|credit|amex|mastercard|karte|tarjeta|carte)[^a-z0-9]{0,3}\S{0,6}\s?$"),
        "said_mail": said(r"(?:mail|contact|write|reach)\s?\S{0,4}\s?(?:to|me|us)?[^a-z0-9]{0,3}$"),
        "said_secret": said(r"(?:password|secret|token|key|credential)s?\W{0,3}(?:is|are)?\W{0,3}$"),
        "quoted": before.rlike("[\"']$"),
    }


FEATURES = ("chars digits upper lower blanks hyphens dots slashes changes groups_334 groups_4444 date_like at_dot bracketed "
            "written_dot assigned known_prefix luhn said_phone said_card said_mail said_secret quoted").split()  # fmt: skip


def candidates(text: Column) -> Column:
    """Array of (kind, s, e, m, f): proposals with their features."""
    digit = text.rlike("[0-9]")
    spot = text.rlike(r"(?i)[\[(](?:at|dot)[\])]|@|\x20dot\x20")
    kind_of_digits = lambda m: F.when(F.length(_digits(m["m"])) >= 13, "card").otherwise("phone")
    named = text.rlike(r"(?i)(?:password|passwd|pwd|secret|token|key)[\"']?\x20?[=:]")
    proposals = [
        (spot, matches(text, WRITTEN), lambda m: F.lit("email")),
        (digit, matches(text, DIGITS), kind_of_digits),
        (digit, matches(text, TOKEN), lambda m: F.lit("secret")),
        (named, matches(text, NAMED), lambda m: F.lit("secret")),
    ]

    def described(m: Column, kind: Column) -> Column:
        start = F.greatest(m["s"] - 24, F.lit(0))
        c = F.struct(kind.alias("kind"), m["s"].alias("s"), m["e"].alias("e"), m["m"].alias("m"), F.substring(text, start + 1, m["s"] - start).alias("before"))
        return let(c, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), F.struct(*[x.cast("double").alias(n) for n, x in _features(c).items()]).alias("f")))

    empty = F.expr(f"CAST(array() AS array<struct<kind:string,s:int,e:int,f:struct<{','.join(f'{n}:double' for n in FEATURES)}>>>)")
    proposed = lambda found, kind: F.transform(found, lambda m: described(m, kind(m)))
    return F.concat(*[F.when(given, proposed(found, kind)).otherwise(empty) for given, found, kind in proposals])


def training_texts(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """Seeded template texts: id, text, and whether the private-looking part of it is private."""
    pick = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k))
    dig = lambda salt, k: F.lpad(pick(salt, 10**k).cast("string"), k, "0")
    word = lambda salt: F.element_at(F.array(*[F.lit(w) for w in "river stone maple harbor linden castle violet meadow timber copper".split()]), (pick(salt, 10) + 1).cast("int"))
    hexes = lambda salt: F.substring(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256), 1, 32)
    body = F.concat(F.lit("4"), dig("c", 14))
    luhn_digit = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(body, i.cast("string")))
    card = F.element_at(F.filter(luhn_digit, lambda d: luhn(d)), 1)
    spaced = F.regexp_replace(card, "([0-9]{4})(?=[0-9])", "$1 ")
    mixed = F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("t"), F.col("id").cast("string")), 256))), "=", "7")
    key = F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(hexes("k"), "abcdef", "gkmpqr"), 1, 16)))
    name = F.element_at(F.array(*[F.lit(w) for w in ("password=", "token: ", "api_key=", "secret = ")]), (pick("n", 4) + 1).cast("int"))
    yes = [
        F.concat(F.lit("("), dig("a", 3), F.lit(") "), dig("b", 3), F.lit("-"), dig("d", 4)),
        F.concat(F.lit("call "), dig("a", 3), F.lit("-"), dig("b", 3), F.lit("-"), dig("d", 4)),
        F.concat(F.lit("tel. 0"), dig("a", 3), F.lit(" "), dig("b", 7)),
        F.concat(F.lit("phone "), dig("a", 10)),
        F.concat(F.lit("card "), spaced),
        F.concat(F.lit("visa "), card),
        F.concat(word("u"), F.lit("."), word("v"), F.lit(" (at) "), word("w"), F.lit(" (dot) com")),
        F.concat(word("u"), F.lit(" at "), word("w"), F.lit(" dot org")),
        F.concat(F.lit("mail "), word("u"), F.lit("[at]"), word("w"), F.lit(".net")),
        key,
        F.concat(name, F.substring(hexes("p"), F.lit(1), (pick("l", 15) + 8).cast("int"))),
        F.concat(F.lit('key "'), hexes("q"), F.lit('"')),
        F.concat(F.lit('"'), F.substring(mixed, F.lit(1), (pick("l", 20) + 20).cast("int")), F.lit('"')),
    ]
    no = [
        F.concat(F.lit("20"), dig("a", 2), F.lit("-0"), pick("b", 9).cast("string"), F.lit("-1"), pick("c", 9).cast("string")),
        F.concat(F.lit("1"), pick("b", 9).cast("string"), F.lit("/0"), pick("c", 9).cast("string"), F.lit("/20"), dig("a", 2)),
        F.concat(F.lit("pages "), dig("a", 4), F.lit("-"), dig("b", 4)),
        F.concat(F.lit("isbn 978-"), pick("a", 9).cast("string"), F.lit("-"), dig("b", 5), F.lit("-"), dig("c", 3), F.lit("-1")),
        F.concat(F.lit("total "), pick("a", 900).cast("string"), F.lit(" 000 000")),
        F.concat(F.lit("order "), dig("a", 8)),
        F.concat(F.lit("number "), dig("a", 12)),
        F.concat(word("u"), F.lit(" at "), word("v"), F.lit("."), word("w")),
        F.concat(word("u"), F.lit(" @ "), word("v"), F.lit(".5")),
        F.concat(word("u"), F.lit("-of-the-"), word("v"), F.lit("-"), word("w"), F.lit("-1")),
        F.concat(word("u"), F.lit("/"), word("v"), F.lit("/"), word("w"), F.lit("/index")),
        F.concat(word("u"), word("v"), word("w"), word("x")),
        F.concat(F.lit("token: "), word("u"), word("v")),
        F.concat(F.lit("version 1."), dig("a", 2), F.lit("."), dig("b", 2), F.lit("."), dig("c", 3)),
    ]
    made = F.element_at(F.array(*[F.struct(x.alias("part"), F.lit(1.0).alias("label")) for x in yes], *[F.struct(x.alias("part"), F.lit(0.0).alias("label")) for x in no]), (F.col("id") % (len(yes) + len(no)) + 1).cast("int"))
    rows = spark.range(0, n, 1, 2).withColumn("made", made)
    return rows.select("id", F.concat(F.lit("The "), word("y"), F.lit(" "), word("z"), F.lit(" "), F.col("made.part"), F.lit(" and then the "), word("y"), F.lit(".")).alias("text"), F.col("made.label").alias("label"))


def _tree(text: str):
    """One tree of a model's debug text: a number, or (feature, operator, value, if true, if false)."""
    lines = [x.strip() for x in text.splitlines() if re.match(r"\s*(?:If|Else|Predict)", x)]

    def read(i: int):
        if m := re.match(r"Predict: (\S+)", lines[i]):
            return float(m[1]), i + 1
        feature, op, value = re.match(r"If \(feature (\d+) (<=|>) (\S+?)\)", lines[i]).groups()
        yes, i = read(i + 1)
        no, i = read(i + 1)  # past Else
        return (FEATURES[int(feature)], op, float(value), yes, no), i

    return read(0)[0]


class Selector:
    """Weighted trees and a threshold a kind; all of it compiles to Columns."""

    def __init__(self, trees: list, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def probability(self, f: Column) -> Column:
        def value(t) -> Column:
            if isinstance(t, float):
                return F.lit(t)
            feature, op, at, yes, no = t
            return F.when(f[feature] <= at if op == "<=" else f[feature] > at, value(yes)).otherwise(value(no))

        margin = F.lit(0.0)
        for weight, tree in self.trees:
            margin = margin + weight * value(tree)
        return 1 / (1 + F.exp(-2 * margin))

    def by_kind(self, kind: Column, values: dict) -> Column:
        out = F.lit(None)
        for k, v in values.items():
            out = F.when(kind == k, F.lit(v)).otherwise(out)
        return out


def train(spark: SparkSession, rounds: int = 10, depth: int = 4) -> Selector:
    """Fits the trees on two thirds of the template candidates and calibrates thresholds on the others."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = training_texts(spark).select("id", "label", F.explode(candidates(F.col("text"))).alias("c"))
    rows = rows.select("id", "label", "c.kind", *[F.col(f"c.f.{n}").alias(n) for n in FEATURES])
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    rows = cut(rows.select("label", "kind", "features", F.struct(*FEATURES).alias("f"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("kept_out")))
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, maxBins=32).fit(rows.where("NOT kept_out").select("label", "features"))
    selector = Selector([(w, _tree(t.toDebugString)) for w, t in zip(model.treeWeights, model.trees, strict=True)], {})
    top = rows.where("kept_out AND label = 0").groupBy("kind").agg(F.max(selector.probability(F.col("f"))).alias("p")).collect()  # one row a kind
    selector.thresholds = {k: LEAST_PROBABILITY for k in KINDS} | {r.kind: max(LEAST_PROBABILITY, r.p) for r in top}
    return selector


def span_arrays(text: Column, selector: Selector) -> Column:
    """struct(base, spans): arrays of (k, s, e) sorted by k, s, e; k is the place of the kind in KINDS."""
    rank = {k: i for i, k in enumerate(KINDS)}
    span = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    touches = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])

    def tagged(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda m: F.struct(F.lit(rank[kind]).alias("k"), m["s"].alias("s"), m["e"].alias("e")))

    def scored(c: Column) -> Column:
        return F.struct(
            (-selector.probability(c["f"])).alias("minus_p"), c["s"].alias("s"), (-c["e"]).alias("minus_e"), selector.by_kind(c["kind"], rank).alias("k"),
            c["e"].alias("e"), (-selector.by_kind(c["kind"], selector.thresholds)).alias("limit"),
        )

    def chosen(z: Column) -> Column:
        likely = F.filter(z["scored"], lambda c: (c["minus_p"] < c["limit"]) & ~F.exists(z["base"], lambda b: touches(b, c)))
        # Structs compare field by field: likelier, earlier, longer first.
        best = let(likely, lambda xs: F.filter(xs, lambda c: ~F.exists(xs, lambda o: touches(o, c) & (o < c))))
        return F.struct(F.array_sort(z["base"]).alias("base"), F.array_sort(F.concat(z["base"], F.transform(best, span))).alias("spans"))

    base = F.concat(*[tagged(k, v) for k, v in base_spans(text).items()])
    return let(F.struct(base.alias("base"), F.transform(candidates(text), scored).alias("scored")), chosen)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_pii(docs: DataFrame, selector: Selector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, pii = struct(base, spans)."""
    return docs.select(F.col(id_col), F.col(text_col), span_arrays(text_or_empty(F.col(text_col)), selector).alias("pii"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each covered stretch replaced by the name of the first kind that covers it, as <EMAIL>."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["pos"] + 1, F.greatest(x["s"] - acc["pos"], F.lit(0)))
        parts = F.when(x["s"] >= acc["pos"], F.concat(acc["out"], F.array(gap, F.get(names, x["k"])))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), parts.alias("out"))

    none = F.struct(F.lit(0).alias("pos"), F.expr("CAST(array() AS array<string>)").alias("out"))
    rest = lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["pos"] + 1, F.length(text)))), "")
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(by_start, none, step, rest))


def redact_pii(docs: DataFrame, selector: Selector, text_col: str = "text") -> DataFrame:
    """docs with the text redacted; all other columns as they are."""
    text = F.col(text_col)
    new = let(span_arrays(text_or_empty(text), selector), lambda z: redacted(text, z["spans"]))
    return docs.withColumn(text_col, F.when(text.isNotNull(), new))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir, "doc_id", "text"), train(spark))
    base = lambda k: F.size(F.filter(F.col("pii.base"), lambda x: x["k"] == k)).cast("long")
    counts = [base(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("pii.base")), 256).alias("base_sha256"), listed(F.col("pii.spans")).alias("spans"))
