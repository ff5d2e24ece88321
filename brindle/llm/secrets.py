"""Secret scans: candidate strings, and a random forest that removes the false positives.

Candidates are (1) the value assigned to a name such as ``token`` or ``password``, (2) runs of at
least 15 key characters that hold a digit, (3) private-key blocks of any length, from BEGIN to the
next END if no other BEGIN stands between, header lines and all. The forest judges each by its
length, character classes and transitions, dictionary coverage, path-likeness and neighbouring
words. It is fitted with numpy on the driver from at most ``max_labelled`` labelled findings; its trees are
then constant arrays walked by Column expressions, so scanning, scoring and redaction are built-in expressions only, row by
row, without a shuffle.

No table marks secrets, so ``labelled_findings`` makes labelled findings from templates; pass
your own frame (before, candidate, after, label) for other corpora.

Null and empty texts have no findings and stay as they are; repeated rows repeat their findings; a null
doc_id is carried as it is. A text may hold any number of candidates: the places of its matches come from
sums over blocks of them, and each match carries only the characters next to it. Columns other
than doc_id and text are ignored by ``find_secrets`` and kept by ``redact``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|auth[_-]?key|access[_-]?key|credential)"
_ASSIGN = rf"{_NAME}[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?"
# Possessive, so that a body of any length is read once and without recursion.
_BODY = r"[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+"
CANDIDATE = (
    rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----{_BODY}-----END [A-Z ]{{0,40}}PRIVATE KEY-----"
    rf"|{_ASSIGN}(?!-----BEGIN )[^\s\"'<>,;:=][^\s\"'<>,;]{{7,}}"
    r"|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=.-]*+[0-9])[A-Za-z0-9][A-Za-z0-9+/_=.-]{14,}"
)
# Every candidate has a digit, BEGIN or a name; texts without these are not searched.
GATE = r"[0-9]|BEGIN|(?i:pass|pwd|secret|token|key|credential)"
# Published key prefixes.
ISSUER = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|ya29\.|eyJ|npm_|SG\.|-----BEGIN)"
# Common English words and word parts.
DICTIONARY = "the and ing tion ment ness able http https www com org net html index page file image user name data test sample example default version release build config server client number value string report section chapter article document".split()
BEFORE, AFTER = 48, 16
FEATURES = (
    "length", "digits", "upper", "lower", "symbols", "hex", "transitions", "dictionary", "path", "named", "benign", "assigned", "issuer", "placeholder", "numeric", "distinct",
)


def features(before: Column, cand: Column, after: Column) -> list[Column]:
    """The forest's inputs as doubles, in the order of FEATURES."""
    n = F.greatest(F.length(cand), F.lit(1)).cast("double")
    low = F.lower(cand)
    near = F.lower(before)

    def share(pattern):
        return F.regexp_count(cand, F.lit(pattern)) / n

    def has(col, pattern):
        return F.coalesce(col.rlike(pattern), F.lit(False)).cast("double")

    # Long candidates by pieces, so that no array holds all their characters.
    by_piece = F.aggregate(F.regexp_extract_all(cand, F.lit("(?s).{1,200}"), F.lit(0)), F.array().cast("array<string>"), lambda s, x: F.array_union(s, F.split(x, "")))
    distinct = F.when(F.length(cand) <= 200, F.array_distinct(F.split(cand, ""))).otherwise(by_piece)
    words = "|".join(sorted(DICTIONARY, key=len, reverse=True))
    return [
        n,
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        share("[^A-Za-z0-9]"),
        has(cand, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        F.regexp_count(cand, F.lit("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])")) / n,
        1 - F.length(F.regexp_replace(low, f"(?:{words})", "")) / n,
        has(F.concat(near, F.lit("\x01"), low), r"://\S*\x01|[/\\]\x01|www\.|\x01\S*[/.][a-z]{2,}|@\S*\x01|\x01\S*@"),
        has(near, r"(?:pass|pwd|secret|token|key|auth|credential|bearer)\S{0,12}\s{0,3}[:=]?\s{0,3}[\"']?$"),
        has(near, r"(?:commit|sha-?\d*|md5|hash|digest|checksum|uuid|guid|revision|isbn|etag|id)\b\S{0,6}\s{0,3}[:=]?\s{0,3}[\"']?$"),
        has(near, r"[:=]\s{0,3}[\"']?$"),
        has(cand, ISSUER),
        has(low, r"(.)\1{5,}|your|changeme|example|placeholder|xxxx|1234567|abcdef"),
        has(cand, r"^[0-9.+/_=-]+$"),
        F.size(distinct).cast("double"),
    ]


def labelled_findings(spark: SparkSession, n: int = 3500) -> DataFrame:
    """before, candidate, after, label: about n findings from templates of keys and of look-alikes, the same for the same n."""
    i = F.col("id")
    h = lambda k: F.sha1(F.concat(i.cast("string"), F.lit(f"/{k}")))
    h64 = F.sha2(F.concat(i.cast("string"), F.lit("/s")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(F.concat(h(1), h(2)))), "[=\\s]", "")
    b62 = F.regexp_replace(b64, "[+/]", "x")
    digits = F.regexp_replace(h64, "[a-f]", "")
    word = F.translate(F.substring(h64, 1, 20), "0123456789", "etaoinshrl")
    line = F.substring(F.concat(b64, b62), 1, 64)
    pem = lambda kind, body: F.concat(F.lit(f"-----BEGIN {kind}-----\n"), body, F.lit(f"-----END {kind}-----"))
    quote = lambda s: F.concat(F.lit(s), F.when(i % 2 == 0, F.lit('"')).otherwise(F.lit("")))
    named = F.element_at(F.array(*[F.lit(x) for x in ("token = ", "secret: ", "api_key=", "password = ", "auth_key = ", "access_key: ", "TOKEN = ")]), (i % 7 + 1).cast("int"))
    named = F.concat(F.lit("the of en "), named, F.when(i % 3 != 0, F.lit('"')).otherwise(F.lit("")))
    plain = F.lit("ation of the ")
    cut = F.lit(10) + (i % 7).cast("int")
    rows = [
        (named, h(0), 1), (named, F.upper(h(0)), 1), (named, F.substring(h64, 1, 32), 1), (named, h64, 1), (named, F.substring(b64, 1, 40), 1),
        (named, F.substring(b62, F.lit(3), cut), 1), (named, F.concat(F.substring(word, 1, 5), F.lit("!"), F.substring(digits, 1, 4)), 1),
        (plain, F.concat(F.lit("AKIA"), F.upper(F.substring(h(3), 1, 16))), 1), (plain, F.concat(F.lit("ghp_"), F.substring(b62, 1, 36)), 1),
        (plain, F.concat(F.lit("sk-"), F.substring(b62, 1, 48)), 1), (plain, F.concat(F.lit("xoxb-"), F.substring(digits, 1, 12), F.lit("-"), F.substring(b62, 1, 24)), 1),
        (plain, F.concat(F.lit("AIza"), F.substring(b62, 1, 35)), 1), (plain, F.concat(F.lit("eyJ"), b62, F.lit("."), F.substring(b62, 4, 40)), 1),
        (plain, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), b64, b64, F.lit("\n-----END RSA PRIVATE KEY-----")), 1),
        (plain, pem("RSA PRIVATE KEY", F.repeat(F.concat(line, F.lit("\n")), 190)), 1), (plain, pem("PRIVATE KEY", F.repeat(F.concat(line, F.lit("\n")), 26)), 1),
        (plain, pem("RSA PRIVATE KEY", F.concat(F.lit("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,"), F.upper(F.substring(h64, 1, 32)), F.lit("\n\n"), F.repeat(F.concat(line, F.lit("\n")), 25))), 1),
        (F.lit("see commit "), h(4), 0), (quote("sha1: "), h(4), 0), (quote("sha256="), h64, 0), (quote("md5 "), F.substring(h64, 1, 32), 0), (quote("etag: "), F.substring(h64, 1, 32), 0),
        (quote("uuid = "), F.concat_ws("-", *[F.substring(h64, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), 0),
        (plain, F.concat_ws("-", *[F.substring(h64, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), 0),
        (plain, F.substring(digits, 1, 16), 0), (plain, F.concat(F.lit("202"), F.substring(digits, 1, 1), F.lit("-0"), F.substring(digits, 2, 1), F.lit("-1"), F.substring(digits, 3, 1), F.lit("T1"), F.substring(digits, 4, 1), F.lit("00"), F.substring(digits, 4, 4)), 0),
        (F.lit("http://www."), F.concat(word, F.lit(".com/en/"), F.substring(digits, 1, 3)), 0), (F.lit("in /usr/"), F.concat(F.lit("local/"), word, F.substring(digits, 1, 2), F.lit(".html")), 0),
        (plain, F.concat(F.substring(word, 1, 9), F.lit("."), F.substring(digits, 1, 2)), 0), (plain, F.concat(word, F.substring(digits, 1, 1)), 0), (plain, F.concat(F.substring(word, 1, 7), F.lit("_report_"), F.substring(digits, 1, 4)), 0),
        (named, F.lit("YOUR_API_KEY_HERE"), 0), (named, F.lit("xxxxxxxxxxxxxxxx1"), 0), (named, F.lit("changeme123456789"), 0), (named, F.concat(F.substring(word, 1, 6), F.lit("_example_"), F.substring(digits, 1, 2)), 0),
        (F.lit("the token: "), F.substring(word, 1, 12), 0), (F.lit("a password = "), word, 0), (F.lit("ISBN "), F.concat(F.lit("978-"), F.substring(digits, 1, 1), F.lit("-"), F.substring(digits, 2, 8), F.lit("-1")), 0),
    ]
    pick = F.array(*[F.struct(b.alias("before"), c.alias("candidate"), F.lit(" of the").alias("after"), F.lit(y).alias("label")) for b, c, y in rows])
    return spark.range(-(-n // len(rows)), numPartitions=4).select(F.inline(pick))


def _split(x: np.ndarray, y: np.ndarray, names: np.ndarray) -> tuple[int, float] | None:
    best, at = 1e-9, None
    n, ones = len(y), y.sum()
    whole = ones * (n - ones) / n
    for f in names:
        order = np.argsort(x[:, f], kind="stable")
        v, left = x[order, f], np.cumsum(y[order])[:-1]
        k = np.arange(1, n)
        gain = whole - left * (k - left) / k - (ones - left) * (n - k - ones + left) / (n - k)
        gain[v[1:] == v[:-1]] = -1
        j = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[j] > best:
            best, at = float(gain[j]), (int(f), float((v[j] + v[j + 1]) / 2))
    return at


def _grow(x, y, rng, depth, tries):
    if depth == 0 or len(y) < 4 or y.min() == y.max():
        return float(y.mean())
    at = _split(x, y, rng.choice(x.shape[1], tries, replace=False))
    if at is None:
        return float(y.mean())
    left = x[:, at[0]] <= at[1]
    return (*at, _grow(x[left], y[left], rng, depth - 1, tries), _grow(x[~left], y[~left], rng, depth - 1, tries))


def fit_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 15, depth: int = 6, tries: int = 5, seed: int = 3) -> list:
    """Bootstrapped trees, each a mean of labels or (feature, threshold, tree if <=, tree if >)."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y))
        out.append(_grow(x[pick], y[pick], rng, depth, tries))
    return out


def forest_score(forest: list, inputs: Column) -> Column:
    """Mean of the leaves that the array ``inputs`` reaches, as one Column.

    The trees stand in constant arrays of features, thresholds, children and values; a leaf is its own child.
    """
    feature, limit, low, high, value = [], [], [], [], []

    def place(t) -> int:
        n = len(feature)
        leaf = isinstance(t, float)
        feature.append(1 if leaf else t[0] + 1)
        limit.append(0.0 if leaf else t[1])
        value.append(t if leaf else 0.0)
        low.append(n + 1)
        high.append(n + 1)
        if not leaf:
            low[n], high[n] = place(t[2]), place(t[3])
        return n + 1

    def depth(t) -> int:
        return 0 if isinstance(t, float) else 1 + max(depth(t[2]), depth(t[3]))

    roots = [place(t) for t in forest]

    def at(values, n):
        kind = "double" if isinstance(values[0], float) else "int"
        return F.element_at(F.expr(f"array({', '.join(f'{v!r}D' if kind == 'double' else str(v) for v in values)})"), n)

    step = lambda n, _: F.when(F.element_at(inputs, at(feature, n)) <= at(limit, n), at(low, n)).otherwise(at(high, n))
    levels = F.expr(f"array_repeat(0, {max(1, *map(depth, forest))})")
    return F.aggregate(F.expr(f"array({', '.join(map(str, roots))})"), F.lit(0.0), lambda s, r: s + at(value, F.aggregate(levels, r, step))) / len(forest)


def train(labelled: DataFrame, *, max_labelled: int = 20_000, **options) -> list:
    """A forest from labelled findings: the ``max_labelled`` with the smallest hash, if there are more."""
    f = features(F.col("before"), F.col("candidate"), F.col("after"))
    rows = labelled.orderBy(F.xxhash64("before", "candidate"), "candidate", "label").limit(max_labelled)
    got = np.array([[float(v) for v in r] for r in rows.select(*f, F.col("label").cast("double")).collect()])
    return fit_forest(got[:, :-1], got[:, -1], **options)


def _parts(text: Column) -> tuple[Column, Column]:
    """The stretches between matches, and the matches (a candidate, with its name and sign if it is an assigned value)."""
    return F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))


def _candidate(match: Column) -> Column:
    return F.regexp_replace(match, "^" + _ASSIGN, "")


def _before(piece: Column, match: Column, candidate: Column) -> Column:
    name = F.left(match, F.length(match) - F.length(candidate))
    return F.right(F.concat(F.right(piece, F.lit(BEFORE)), name), F.lit(BEFORE))


def find_secrets(docs: DataFrame, forest: list, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, start (in characters, from 0), n_chars, candidate, score of the findings that the forest confirms."""
    pieces, found = _parts(F.col("text"))
    base = docs.where(F.col("text").rlike(GATE)).select("doc_id", found.alias("found"), pieces.alias("pieces"))
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)
    cut = lambda values, first, n: F.slice(values, first.cast("int") + 1, n.cast("int"))
    span = F.lit(256)
    base = base.where(F.size("found") > 0).withColumn("lengths", F.transform("found", lambda m, i: (F.length(F.element_at("pieces", i + 1)) + F.length(m)).cast("long")))
    blocks = F.sequence(F.lit(0), F.floor((F.size("lengths") - 1) / span).cast("int"))
    base = base.withColumn("sums", F.transform(blocks, lambda k: total(cut(F.col("lengths"), k * span, span))))
    base = base.withColumn("upto", F.transform("sums", lambda _, k: total(cut(F.col("sums"), F.lit(0), k))))

    def one(match, i):
        k = F.floor(i / span).cast("int")
        end = F.element_at("upto", k + 1) + total(cut(F.col("lengths"), k * span, i - k * span + 1))
        return F.struct(match.alias("match"), F.right(F.element_at("pieces", i + 1), F.lit(BEFORE)).alias("piece"), F.left(F.element_at("pieces", i + 2), F.lit(AFTER)).alias("after"), end.alias("end"))

    rows = base.select("doc_id", F.inline(F.transform("found", one))).withColumn("candidate", _candidate(F.col("match")))
    near = rows.select("doc_id", "candidate", "after", _before(F.col("piece"), F.col("match"), F.col("candidate")).alias("before"), (F.col("end") - F.length("candidate")).alias("start"))
    judged = near.select("doc_id", "candidate", "start", F.array(*features(F.col("before"), F.col("candidate"), F.col("after"))).alias("x"))
    scored = judged.select("doc_id", "start", F.length("candidate").cast("long").alias("n_chars"), "candidate", forest_score(forest, F.col("x")).alias("score"))
    return scored.where(F.col("score") >= threshold)


def redact(docs: DataFrame, forest: list, *, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every confirmed secret in ``text`` replaced by ``mark``; all other columns and rows stay."""
    own = lambda n: n if n not in docs.columns else own(n + "_")
    names = own("pieces"), own("found")
    gate = F.col("text").rlike(GATE)
    split = docs.select("*", *[F.when(gate, c).otherwise(F.array().cast("array<string>")).alias(n) for n, c in zip(names, _parts(F.col("text")), strict=True)])
    pieces, found = map(F.col, names)

    def judge(match, i):
        piece, after = F.element_at(pieces, i + 1), F.left(F.element_at(pieces, i + 2), F.lit(AFTER))

        def one(c):
            score = F.transform(F.array(F.array(*features(_before(piece, match, c), c, after))), lambda f: forest_score(forest, f))
            return F.when(F.element_at(score, 1) >= threshold, F.concat(F.left(match, F.length(match) - F.length(c)), F.lit(mark))).otherwise(match)

        return F.element_at(F.transform(F.array(_candidate(match)), one), 1)

    clean = F.zip_with(F.transform(found, judge), F.slice(pieces, 2, F.size(found)), lambda a, b: F.concat(a, b))
    joined = F.concat(F.element_at(pieces, 1), F.array_join(clean, ""))
    text = F.when(F.size(found) > 0, joined).otherwise(F.col("text")).alias("text")
    return split.select(*[text if n == "text" else F.col(n) for n in docs.columns])
