"""Secret scans: pattern candidates, and a random forest against false positives.

Candidates are what the patterns below find in the whole text. Each gets
numeric features: its length, the rates of change between character classes,
entropy, coverage by dictionary words (those of a vocabulary file, which is
read and not kept here), what kind of path or assignment it
stands in, and whether neighbouring words speak of secrets or of digests and
placeholders. A random forest trained on labelled findings gives the
probability that a candidate is a live secret.

The forest is fitted by Spark's own trainer on at most ``FIT_ROWS`` labelled
findings (those with the least hash; a bound on the fit alone), and applied by
a plain expression of its splits in workers. The labelled findings are an
input; ``example_findings`` makes a set of them from the public formats.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import string
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import trimmed, two_columns

FIT_ROWS = 20_000
TREES, DEPTH, SEED = 32, 8, 7
#: characters on either side that are read for neighbouring words
NEAR = 60

# fixed values: public formats of credentials: name, the strings one of which a
# match starts with (lower case: in any case), and the pattern, whose group is the secret
RULES = (
    ("aws_access_key", ("AKIA", "ASIA"), r"(?<!\w)((?:AKIA|ASIA)[0-9A-Z]{16})(?!\w)"),
    ("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(?<!\w)(gh[pousr]_[0-9A-Za-z]{36,})(?!\w)"),
    ("slack_token", ("xox",), r"(?<!\w)(xox[abprs]-[0-9A-Za-z-]{10,})"),
    ("jwt", ("eyJ",), r"(?<!\w)(eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]*)"),
    ("private_key", ("-----BEGIN ",), r"(-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----)"),
    ("url_password", ("://",), r"://[^\s/:@]+:([^\s/:@]{3,})@"),
    (
        "assignment",
        ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "accesskey", "auth", "credential"),
        r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access_?key|auth|credential)[\w.-]{0,40}[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?([^\s\"',;]{6,})",
    ),
    ("hex", None, r"(?<!\w)([0-9a-f]{32,})(?!\w)"),
    ("base64", None, r"(?<![\w+/=-])([\w+/-]{32,}={0,2})(?![\w+/=-])"),
)
LONG = 32
_RULES = [(i, starts, re.compile(p, re.ASCII)) for i, (_, starts, p) in enumerate(RULES)]
# fixed values: words that stand near secrets, near digests and in placeholders
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "key", "credential", "auth", "login", "bearer", "private")
DIGEST_WORDS = ("sha1", "sha256", "md5", "checksum", "digest", "hash", "commit", "revision", "etag", "uuid", "integrity", "fingerprint")
PLACEHOLDERS = ("example", "changeme", "your", "xxxx", "dummy", "placeholder", "sample", "test", "todo", "redacted", "none", "null", "insert", "****", "1234")
_COMMON = ("the", "and", "for", "that", "with", "this", "from", "have", "not", "are", "was", "you", "all", "can", "use", "get", "set", "value", "name", "user", "data", "file", "path", "config", "environment", "variable", "string", "return", "function", "default", "here", "some", "word")
#: letters of a dictionary word; shorter ones turn up in random strings
WORD_LETTERS = range(4, 16)
FEATURES = (
    "rule", "length", "to_digit", "to_lower", "to_upper", "to_other", "digits", "uppers", "entropy", "distinct", "dictionary", "longest_letters",
    "placeholder", "secret_near", "digest_near", "quoted", "in_path", "in_url",
)


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def dictionary(vocabulary_path: str) -> frozenset:
    """Whole words of letters in a ``tokenizers`` .json vocabulary, which bounds their number."""
    with open(vocabulary_path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    pieces = pieces if isinstance(pieces, dict) else [p for p, _ in pieces]
    words = (p.removesuffix("</w>").lstrip("\u0120\u2581").lower() for p in pieces if p.endswith("</w>") or p[:1] in "\u0120\u2581")
    return frozenset(w for w in words if len(w) in WORD_LETTERS and w.isascii() and w.isalpha()) | {w for w in PLACEHOLDERS if w.isalpha()}


def covered_letters(value: str, words: frozenset) -> int:
    """Characters of ``value`` (lower case) in dictionary words, the longest word at each place first."""
    total = 0
    for run in re.findall(r"[a-z]{4,}", value):
        i = 0
        while i <= len(run) - WORD_LETTERS[0]:
            k = next((k for k in range(min(WORD_LETTERS[-1], len(run) - i), WORD_LETTERS[0] - 1, -1) if run[i:i + k] in words), 0)
            total, i = total + k, i + max(k, 1)
    return total


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(rule index, start, end) by start; of those that overlap, the one of the earlier rule."""
    found: list[tuple[int, int, int]] = []  # start, end, rule
    low = _lower(text)
    long = None
    for i, starts, pattern in _RULES:
        if starts is None:
            # words of this length are few: most texts end here
            long = any(len(w) >= LONG for w in text.split()) if long is None else long
            spans = [m.span(1) for m in pattern.finditer(text)] if long else []
            if RULES[i][0] == "base64":
                spans = [(a, e) for a, e in spans if any(c.isdigit() for c in text[a:e]) and any(c.isupper() for c in text[a:e])]
        else:
            spans = []
            for x in starts:
                where = low if RULES[i][0] == "assignment" else text
                at = where.find(x)
                while at >= 0:
                    if m := pattern.match(text, at):
                        spans.append(m.span(1))
                    at = where.find(x, at + 1)
        for a, e in spans:
            # what was found before is apart and in order, so only the neighbours can overlap
            k = bisect_left(found, (a, e))
            if (k == 0 or found[k - 1][1] <= a) and (k == len(found) or e <= found[k][0]):
                insort(found, (a, e, i))
    return [(i, a, e) for a, e, i in found]


def describe(rule: int, value: str, before: str, after: str, words: frozenset) -> list[float]:
    """The features of one candidate in its surroundings."""
    n = len(value)
    kind = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o" for c in value]
    change = {k: 0 for k in "dluo"}
    for a, b in zip(kind, kind[1:]):
        if a != b:
            change[b] += 1
    count: dict[str, int] = {}
    for c in value:
        count[c] = count.get(c, 0) + 1
    low = value.lower()
    letters = re.findall(r"[a-z]{3,}", low)
    near = (before[-NEAR:] + " " + after[:NEAR]).lower()
    around = set(re.findall(r"[a-z0-9]+", near.replace("_", " ")))
    last = re.search(r"\S*$", before)[0]
    return [
        float(rule), float(n), *(change[k] / max(1, n - 1) for k in "dluo"), kind.count("d") / max(1, n), kind.count("u") / max(1, n),
        -sum(c / n * math.log2(c / n) for c in count.values()) if n else 0.0, len(count) / max(1, n), covered_letters(low, words) / max(1, n),
        float(max((len(w) for w in letters), default=0)), float(any(p in low for p in PLACEHOLDERS)), float(sum(w in around for w in SECRET_WORDS)),
        float(sum(w in around for w in DIGEST_WORDS)), float(before[-1:] in "\"'" and before != ""), float("/" in last and "://" not in last), float("://" in last),
    ]


def example_findings(spark: SparkSession, n: int = 4000, seed: int = SEED) -> DataFrame:
    """``(rule, value, before, after, label)``: made findings, half of them live secrets.

    Live ones are random strings in the public formats; the others what
    the same patterns catch besides: digests, commit ids, identifiers in paths, and
    placeholders.
    """
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    word = lambda: pick("etaoinshrdlu", rng.randint(2, 9))
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 8)))
    name = {r: i for i, (r, *_) in enumerate(RULES)}
    rows = []
    for i in range(n):
        a, b = prose(), prose()
        q = rng.choice(["", '"', "'"])
        if i % 2 == 0:
            rule, value, before = rng.choice((
                ("aws_access_key", rng.choice(("AKIA", "ASIA")) + pick(upper, 16), rng.choice((" ", " key=", " aws_access_key_id = " + q))),
                ("github_token", "ghp_" + pick(alnum, 36), rng.choice((" ", " token: ", " GITHUB_TOKEN=" + q))),
                ("slack_token", "xoxb-" + pick("0123456789", 12) + "-" + pick(alnum, 24), rng.choice((" ", " slack = " + q))),
                ("jwt", "eyJ" + pick(alnum, 20) + "." + pick(alnum, 40) + "." + pick(alnum, 43), rng.choice((" Authorization: Bearer ", " jwt "))),
                ("private_key", "-----BEGIN " + rng.choice(("RSA ", "EC ", "OPENSSH ", "")) + "PRIVATE KEY-----", "\n"),
                ("url_password", pick(alnum, rng.randint(8, 20)), " postgres://" + word() + ":"),
                ("assignment", pick(rng.choice((hexa, alnum)), rng.randint(12, 44)), rng.choice((" password=", " token = " + q, " secret: " + q, " api_key=", " passwd = " + q))),
                ("hex", pick(hexa, rng.choice((32, 40, 64))), rng.choice((" private key ", " auth token ", " secret "))),
                ("base64", pick(alnum + "+/", rng.randint(36, 64)), rng.choice((" credential ", " bearer ", " secret key "))),
            ))
        else:
            rule, value, before = rng.choice((
                ("aws_access_key", "AKIA" + rng.choice(("IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "EXAMPLEKEY123456")), rng.choice((" ", " key="))),
                ("github_token", "ghp_" + rng.choice(("x" * 36, "EXAMPLE" * 6, "your" * 10)), " token: "),
                ("slack_token", "xoxb-your-token-here", " slack = " + q),
                ("jwt", "eyJ" + "example" * 3 + "." + "placeholder" + ".", " jwt "),
                ("url_password", rng.choice(("password", "example", "changeme", "yourpassword")), " postgres://user:"),
                ("assignment", rng.choice(("changeme", "your_password_here", "<password>", "${PASSWORD}", "os.environ[KEY]", "xxxxxxxx", "example123", "getToken(user)", "none_set", "config.value", "required", "string_value")), rng.choice((" password=", " token = " + q, " secret: "))),
                ("hex", pick(hexa, rng.choice((32, 40, 64))), rng.choice((" sha256 ", " md5 checksum ", " commit ", " git revision ", " etag ", " integrity digest ", " objects/ab/", " /var/cache/" + word() + "/"))),
                ("base64", pick(alnum, 44) + "=", rng.choice((" integrity sha256-", " fingerprint ", " /static/js/"))),
                ("base64", "".join(w.capitalize() for w in rng.choices(_COMMON, k=7)) + "2", rng.choice((" class ", " import ", " com/" + word() + "/"))),
            ))
        rows.append((name[rule], value, f"{a}{before}", f"{q if before.endswith(q) and q else ''} {b}", 1 - i % 2))
    return spark.createDataFrame(rows, "rule int, value string, before string, after string, label int")


class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left, right, probability; and the dictionary they were fitted with."""

    def __init__(self, trees, words):
        self.trees, self.words = trees, words

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                at = np.where(inner, np.where(x[np.arange(len(x)), f] <= threshold[at], left[at], right[at]), at)
            total += value[at]
        return total / max(1, len(self.trees))


def fit(findings: DataFrame, words: frozenset) -> Forest:
    """Train on ``(rule, value, before, after, label)``.

    Rows with a null rule, value or label are left out, other nulls are empty; repeated rows count each.
    Rows of one label alone raise an error.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    spark = findings.sparkSession
    rows = (
        findings.where("value is not null and label is not null and rule is not null")
        .orderBy(F.xxhash64("value", "before", "after"), "value").limit(FIT_ROWS).collect()
    )
    if len({r.label for r in rows}) < 2:
        raise ValueError("findings of both labels are needed")
    data = spark.createDataFrame(
        [(float(r.label), Vectors.dense(describe(r.rule, r.value, r.before or "", r.after or "", words))) for r in rows], ["label", "features"]).coalesce(1)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=3).fit(data)
    trees = []
    for tree in model.trees:
        cols: list[list] = [[], [], [], [], []]

        def walk(node):
            k = len(cols[0])
            leaf = node.numDescendants() == 0
            stats = node.impurityStats()
            total = stats.stats()[0] + stats.stats()[1]
            split = None if leaf else node.split()
            for c, v in zip(cols, (-1 if leaf else split.featureIndex(), 0.0 if leaf else split.threshold(), 0, 0, stats.stats()[1] / total if total else 0.5)):
                c.append(v)
            if not leaf:
                cols[2][k] = walk(node.leftChild())
                cols[3][k] = walk(node.rightChild())
            return k

        walk(tree._call_java("rootNode"))
        trees.append(tuple(np.array(c) for c in cols))
    return Forest(trees, words)


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, rule, start, end, value_sha256, probability, secret)`` for each candidate.

    ``start`` and ``end`` are character places in the text; the value itself is
    not handed on, only its digest. A null or empty text has no candidate;
    repeated rows give repeated candidates; a null id comes back null. An empty
    table gives an empty table. Extra columns are pruned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            x = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for rule, s, e in candidates(text):
                    x.append(describe(rule, text[s:e], text[max(0, s - 2 * NEAR):s], text[e:e + 2 * NEAR], shared.value.words))
                    for c, v in zip(out, (doc_id, RULES[rule][0], s, e, hashlib.sha256(text[s:e].encode()).hexdigest())):
                        c.append(v)
            p = np.round(shared.value(np.array(x)), 6) if x else np.zeros(0)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(out, kinds)), pa.array(p, pa.float64()), pa.array(p >= threshold)],
                ["doc_id", "rule", "start", "end", "value_sha256", "probability", "secret"])

    return two_columns(docs, id_col, text_col).mapInArrow(
        trimmed(run), "doc_id long, rule string, start long, end long, value_sha256 string, probability double, secret boolean")
