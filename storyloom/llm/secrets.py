"""Secret scans: patterns find candidates, a random forest trained on labelled findings removes false positives.

The forest sees a candidate's length, the transitions between its characters, how much of it a dictionary covers, the
words of the path it was found under and the words around it. The dictionary is the list of words of a vocabulary file, and
the credentials' words below without one.
"""

from __future__ import annotations

import functools
import json
import math
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SEED, session, slices

THRESHOLD = 0.5
TREES, DEPTH, LEAF = 40, 9, 3
REACH = 48  # characters on either side that count as neighbourhood
PLACEHOLDER = "[SECRET]"

# Formats of known keys, and words that tell credentials from other long strings.
CREDENTIAL_WORDS = set("token secret password passwd pwd apikey api key auth authorization bearer credential credentials access private client session signing aws github slack stripe".split())
HARMLESS_WORDS = set("sha sha1 sha256 md5 commit checksum digest hash uuid guid id revision etag integrity fingerprint version build isbn doi order invoice phone call card email mail ref page serial".split())
DUMMY_WORDS = set("example sample dummy test testing fake placeholder changeme your yourtoken redacted xxxx todo none null undefined default demo insert here replace foo bar baz lorem ipsum".split())
DICTIONARY = frozenset(CREDENTIAL_WORDS | HARMLESS_WORDS | DUMMY_WORDS | set("the and for with that this from have are not was you all can will one out use get set new data file name user home main page view list item type value text string number config settings service server client system local remote public model table index query result error message event handler module package import class function method object array image video account login admin manager controller request response".split()))
SHORTEST, LONGEST = 4, 14  # letters of a dictionary word that counts

_KNOWN = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_\-]{30,}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}|glpat-[A-Za-z0-9_\-]{16,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|sk-(?:[a-z]{2,8}-)*[A-Za-z0-9_\-]{20,}|shp(?:at|ss|ca|pa)_[a-fA-F0-9]{32}|do[opr]_v1_[a-f0-9]{64}|pypi-[A-Za-z0-9_\-]{40,}|[0-9]{8,10}:AA[A-Za-z0-9_\-]{33}|T[A-Z0-9]{8,11}/B[A-Z0-9]{8,11}/[A-Za-z0-9]{20,}"
_LOGIN = r"\b[a-zA-Z][a-zA-Z0-9+.\-]{0,30}://[^\s:/@\"']*:(?P<login>[^\s@/\"']{3,})@"
# What a name of a credential has in it, the name's end, and a value, which ends before the next parameter of a URL.
_NAMED = r"(?=[AaBbCcPpSsTt])(?i:password|passwd|pwd|secret|token|credentials?|bearer|authorization|(?:api|access|private|auth|signing)[_.\-]?key)"
_ASSIGNED = r"[A-Za-z0-9_.\-]{0,32}[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?"
_VALUE = r"(?:(?!&[A-Za-z0-9_.\-]+=)[^\s\"',;]){8,}"
_PATTERN = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:(?s:(?:(?!-----BEGIN ).)*?)-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----|(?:\s*[A-Z][A-Za-z\-]*:[^\n]*\n)*[^-]*)"
    r"|" + _LOGIN + r"|(?<![A-Za-z0-9_\-])(?P<known>" + _KNOWN + r")(?![A-Za-z0-9_\-])"
    r"|" + _NAMED + r"(?:" + _ASSIGNED + r"(?P<given>(?!(?i:bearer|basic|token)\b)" + _VALUE + r")|[ \t](?P<bare>(?=[^\s\"',;]*(?:[0-9!#%&*$]|[a-z][A-Z]))" + _VALUE + r"))"
    r"|(?<![A-Za-z0-9_+/@\-])(?=[A-Za-z0-9+/_\-]{20})(?![A-Za-z0-9_\-]*" + _NAMED + _ASSIGNED + _VALUE + r")(?P<long>(?=[A-Za-z0-9+/_\-]*[0-9])[A-Za-z0-9+/_\-]{20,}={0,2})(?![A-Za-z0-9_+/@])"
)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[a-z0-9]+")


def candidates(text: str):
    """(start, end, kind) of what might be a secret, left to right."""
    for m in _PATTERN.finditer(text):
        kind = m.lastgroup or "private_key"
        yield (*(m.span(kind) if m.lastgroup else m.span()), kind)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


@functools.cache
def dictionary(path: str | None) -> frozenset[str]:
    """The whole words of a tokenizers vocabulary with word ends, in lower case; DICTIONARY without a file."""
    if path is None:
        return DICTIONARY
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = (w.removesuffix("</w>") for w in vocabulary if w.endswith("</w>"))
    return DICTIONARY | {w for w in words if w.isascii() and w.isalpha() and w.islower()}


def coverage(low: str, words: frozenset[str]) -> float:
    """The share of a lower-case text that dictionary words cover, taken from the left, the longest first."""
    at = covered = 0
    while at < len(low):
        size = next((n for n in range(min(LONGEST, len(low) - at), SHORTEST - 1, -1) if low[at : at + n] in words), 0)
        covered += size
        at += size or 1
    return covered / max(len(low), 1)


def features(secret: str, before: str, after: str, path: str, words: frozenset[str] = DICTIONARY) -> list[float]:
    """Numbers that the forest decides by."""
    n = max(len(secret), 1)
    counts: dict[str, int] = {}
    for c in secret:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    kinds = [_kind(c) for c in secret]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n
    repeats = sum(a == b for a, b in zip(secret, secret[1:], strict=False)) / n
    steps = sum(ord(b) - ord(a) == 1 for a, b in zip(secret, secret[1:], strict=False)) / n
    low = secret.lower()
    near, far = (_WORD.findall(_CAMEL.sub(" ", t).lower()) for t in (before, after))
    last = near[-3:]
    places = set(_WORD.findall(path.lower()))
    return [
        float(n), entropy, changes, repeats, steps, coverage(low, words),
        sum(c.isdigit() for c in secret) / n, sum(c.isupper() for c in secret) / n, sum(c in "0123456789abcdefABCDEF" for c in secret) / n,
        float(sum(w in CREDENTIAL_WORDS for w in last)), float(sum(w in HARMLESS_WORDS for w in last)),
        float(sum(w in CREDENTIAL_WORDS for w in near + far)), float(any(w in DUMMY_WORDS for w in near + far)),
        float(bool(re.search(r"[:=]\s{0,3}[\"']?\Z", before))), float(bool(places & DUMMY_WORDS)), float(len(set(low)) / n),
        float(low.count("-") / n), float(bool(re.match(_KNOWN, secret))),
        float(bool(re.search(r"://[^\s:/@]*:\Z", before))), float(bool(re.fullmatch(r"[A-Za-z]+[.!?,]?", secret))),
    ]


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left and right child, share of true findings; and the words of
    the dictionary that the features go by."""

    trees: tuple[tuple[np.ndarray, ...], ...]
    words: frozenset[str] = DICTIONARY

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                goes = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            total += share[at]
        return total / max(len(self.trees), 1)


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = SEED) -> Forest:
    """A forest of Gini trees, each on a bootstrap sample, each split on a random part of the features."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        nodes: list[list[float]] = []

        def grow(rows, depth, nodes=nodes):
            at = len(nodes)
            share = float(y[rows].mean())
            nodes.append([-1, 0.0, 0, 0, share])
            if depth == DEPTH or share in (0.0, 1.0) or len(rows) < 2 * LEAF:
                return at
            best = (1e-9, None, None)
            n, ones = len(rows), y[rows].sum()
            whole = ones * (n - ones) / n
            for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, c = x[order, f], np.cumsum(y[order])
                i = np.flatnonzero(v[1:] > v[:-1]) + 1
                i = i[(i >= LEAF) & (n - i >= LEAF)]
                if len(i):
                    a = c[i - 1]
                    gain = whole - a * (i - a) / i - (ones - a) * (n - i - ones + a) / (n - i)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), int(f), float((v[i[k]] + v[i[k] - 1]) / 2))
            if best[1] is not None:
                goes = x[rows, best[1]] <= best[2]
                left, right = grow(rows[goes], depth + 1), grow(rows[~goes], depth + 1)
                nodes[at][:4] = [best[1], best[2], left, right]
            return at

        grow(rows, 0)
        cols = list(zip(*nodes, strict=True))
        out.append((np.array(cols[0], dtype=np.int64), np.array(cols[1]), np.array(cols[2], dtype=np.int64), np.array(cols[3], dtype=np.int64), np.array(cols[4])))
    return Forest(tuple(out))


def labelled_findings(n: int = 3000, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """(secret, before, after, path, label): generated findings of known formats, true ones and look-alikes."""
    rng = random.Random(seed)
    hexes, b62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    prose = lambda k: " ".join(draw("abcdefghijklmnoprstuvw", rng.randint(2, 9)) for _ in range(k))
    names = ["token", "secret", "api_key", "apikey", "password", "access_key", "auth_token", "client_secret", "TOKEN", "API_KEY", "Authorization: Bearer"]
    harmless = ["commit", "sha256", "sha1", "md5", "checksum", "uuid", "order", "etag", "digest", "id", "revision", "integrity", "build", "ref"]
    join = [" = \"", "=\"", ": \"", "=", ": ", "='", " = '"]
    paths = ["src/app/main.py", "config/settings.yml", "deploy/.env", "src3", "src17", "web", "notes/readme.md", ""]
    tests = ["tests/test_auth.py", "docs/example.md", "samples/demo.json", "fixtures/fake.yml"]
    out = []
    for i in range(n):
        left, right = prose(rng.randint(0, 6)), prose(rng.randint(0, 5))
        upper = rng.random() < 0.1
        if i % 2:
            value = rng.choice([draw(hexes, rng.choice([32, 40, 40, 64])), draw(b62, rng.randint(20, 44)), draw(b62 + "+/", 40), "ghp_" + draw(b62, 36), "AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "sk_live_" + draw(b62, 24), "xoxb-" + draw("0123456789", 11) + "-" + draw(b62, 24), draw(b62 + "!#%&*", rng.randint(10, 18))])
            q = rng.choice(join)
            before = f"{left} {rng.choice(names)}{q if rng.random() < 0.95 else ' '}"
            after = ("\"" if "\"" in q else "'" if "'" in q else "") + " " + right
            path, label = rng.choice(paths + tests[:1]), 1
        else:
            fake = rng.random()
            before, path = f"{left} ", rng.choice(paths + tests)
            if fake < 0.35:  # hashes and identifiers
                value = rng.choice([draw(hexes, rng.choice([32, 40, 64])), "-".join(draw(hexes, k) for k in (8, 4, 4, 4, 12)), draw("0123456789", rng.randint(20, 24))])
                before = f"{left} {rng.choice(harmless)}{rng.choice([' ', ': ', ' = ', '='])}"
            elif fake < 0.6:  # placeholders
                value = rng.choice(["your_api_key_here_123", "changeme12345678", "example-token-0000000", "xxxxxxxxxxxxxxxxxxxx1", "insert-your-token-here-1", "test_password_1", "1234567890123456789012", "abcdefghijklmnopqrstuvwxyz1", "REDACTED0000000000000", "dummy_secret_value_42", "00000000000000000000", "${API_TOKEN_VALUE_1}", "foo-bar-baz-12345-demo"])
                before = f"{left} {rng.choice(names)}{rng.choice(join)}"
            elif fake < 0.85:  # paths, slugs and long words
                value = rng.choice(["/".join(draw("abcdefghijklmnoprstuvw", rng.randint(3, 9)) for _ in range(4)) + str(rng.randint(1, 99)), "-".join(rng.choice(["new", "user", "list", "page", "data", "file", "main", "view"]) for _ in range(6)) + f"-{rng.randint(1, 2024)}", "_".join(rng.choice(["get", "set", "value", "index", "table", "handler", "module"]) for _ in range(5)) + str(rng.randint(1, 9)), "2024-01-02T03-04-05-" + draw("0123456789", 6), draw("abcdefghijklmnoprstuvw", 22) + "1"])
            else:  # bare digests in prose, without a name before them
                value = draw(hexes, rng.choice([32, 40, 64]))
            after, label = " " + right, 0
        if upper:
            value, before, after = value.upper(), before.upper(), after.upper()
        out.append((value, before[-REACH:], after[:REACH], path, label))
    return out


def labelled_keys(n: int = 300, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """Rows like those of labelled_findings, of private key blocks: keys, plain or encrypted, and placeholders."""
    rng = random.Random(seed)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    out = []
    for i in range(n):
        kind = rng.choice(["", "RSA ", "EC ", "DSA ", "OPENSSH ", "ENCRYPTED "])
        head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + "".join(rng.choice("0123456789ABCDEF") for _ in range(32)) + "\n\n" if rng.random() < 0.4 else ""
        if i % 3:
            body, label = "\n".join("".join(rng.choice(b64) for _ in range(64)) for _ in range(rng.randint(2, 50))), 1
        else:
            body, label = rng.choice(["...", "your key here", "EXAMPLE", "REDACTED", "<insert private key>", "xxxxxxxxxxxxxxxx\nxxxxxxxxxxxxxxxx", "placeholder"]), 0
        end = f"\n-----END {kind}PRIVATE KEY-----" if rng.random() < 0.8 else ""
        before = rng.choice(["", "key: ", "private_key = \"", "\n", "and here is "])
        out.append((f"-----BEGIN {kind}PRIVATE KEY-----\n{head}{body}{end}", before, rng.choice(["", "\n", "\" ", " and"]), rng.choice(["deploy/.env", "src3", "web", ""]), label))
    return out


def labelled_assignments(n: int = 1200, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """Rows like those of labelled_findings, of short passwords and compound names; words and placeholders for them."""
    rng = random.Random(seed + 1)
    hexes, b62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    letters = "abcdefghijklmnoprstuvw"
    names = ["password", "passwd", "pwd", "DB_PASSWORD", "db_password", "client_secret", "access_token", "AUTH_TOKEN", "secret_key", "AWS_SECRET_ACCESS_KEY", "clientSecret", "token", "PASSWORD"]
    out = []
    for i in range(n):
        left, right = (" ".join(draw(letters, rng.randint(2, 9)) for _ in range(rng.randint(0, 6))) for _ in range(2))
        join = rng.choice(["=", "=", ": ", " = ", "=\"", ": \"", "='"])
        if i % 2:
            value, label = rng.choice([draw(hexes, rng.randint(12, 24)), draw(b62, rng.randint(10, 40)), draw(b62 + "!#%&*$", rng.randint(9, 20))]), 1
        else:
            value, label = rng.choice([draw(letters, rng.randint(8, 14)), "changeme123", "your_password_here", "<password>", "${DB_PASSWORD}", "********", "required.", "os.environ[", "process.env.TOKEN", "test_password_1", "example-token-0000000", "placeholder"]), 0
        after = ("\"" if "\"" in join else "'" if "'" in join else "") + " " + right
        out.append((value, f"{left} {rng.choice(names)}{join}"[-REACH:], after[:REACH], rng.choice(["src/app/main.py", "deploy/.env", "src3", "src17", "web", ""]), label))
    return out


def labelled_formats(n: int = 1600, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """Rows like those of labelled_findings, of the formats of known keys, logins in addresses and passwords of words;
    names, versions, addresses without a secret and words for them."""
    rng = random.Random(seed + 2)
    digits, hexes, upper = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    b62 = upper + upper.lower() + digits
    draw = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    common = sorted(w for w in DICTIONARY - CREDENTIAL_WORDS - DUMMY_WORDS if len(w) > 3)
    known = [lambda: "npm_" + draw(b62, 36), lambda: "hf_" + draw(b62, 34), lambda: f"SG.{draw(b62, 22)}.{draw(b62, 43)}", lambda: "sk-" + draw(b62, 48), lambda: "shpat_" + draw(hexes, 32), lambda: "dop_v1_" + draw(hexes, 64), lambda: draw(digits, 9) + ":AA" + draw(b62, 33), lambda: "glpat-" + draw(b62, 20), lambda: f"T{draw(upper, 9)}/B{draw(upper, 9)}/{draw(b62, 24)}", lambda: "AIza" + draw(b62, 35), lambda: f"eyJ{draw(b62, 17)}.{draw(b62, 60)}.{draw(b62, 43)}", lambda: "AKIA" + draw(upper + digits, 16), lambda: "ghp_" + draw(b62, 36)]
    password = lambda: rng.choice([lambda: rng.choice(common) + draw(digits, rng.randint(1, 4)) + rng.choice(["", "!", "#", "$"]), lambda: (rng.choice(common) + draw(digits, 1)) * 2, lambda: rng.choice(common) + draw(digits, rng.randint(1, 2)) + rng.choice(common) + rng.choice(["", "!", "?"]), lambda: rng.choice(common).capitalize() + rng.choice(common).capitalize() + draw(digits, 2), lambda: draw(b62 + "!#%", rng.randint(8, 16))])()
    out = []
    for i in range(n):
        left, right = (" ".join(rng.choice(common) for _ in range(rng.randint(0, 6))) for _ in range(2))
        path, kind, label = rng.choice(["src/app/main.py", "deploy/.env", "src3", "src17", "web", ""]), rng.random(), i % 2
        if label and kind < 0.5:
            value, before = rng.choice(known)(), left + rng.choice([" ", " token: ", " key=", "\n", " \"", "=", "https://hooks.host.example/services/"])
        elif label and kind < 0.75:
            value, before = password(), f"{left} {rng.choice(['postgres', 'mysql', 'redis', 'https', 'amqp', 'mongodb+srv'])}://{rng.choice([*common, ''])}:"
            right = f"@{rng.choice(common)}.example/{right}"
        elif label:
            value, before = password(), f"{left} {rng.choice(['password', 'Password', 'passwd', 'pwd', 'DB_PASSWORD', 'PASSWORD'])}{rng.choice([': ', '=', ' = ', '=' + chr(34)])}"
        elif kind < 0.3:
            value, before = rng.choice(["password", "secret", "<password>", "${PASS}", "user", "xxxxxxxx", "$DB_PASSWORD", "changeme"]), f"{left} {rng.choice(['postgres', 'https', 'redis'])}://{rng.choice(common)}:"
            right = f"@{rng.choice(['localhost', 'host', 'example.com'])}/{right}"
        elif kind < 0.6:
            value, before = rng.choice(common) + rng.choice([".", "", ",", " "]).strip(), f"{left} {rng.choice(['password', 'token', 'secret', 'Token', 'credentials'])}{rng.choice([': ', '=', ' = '])}"
            value = value if len(value) > 7 else value + "ment"
        else:
            value, before = rng.choice([lambda: "-".join(rng.choice(common) for _ in range(4)) + "-" + draw(digits, 2), lambda: "_".join(rng.choice(common) for _ in range(4)) + "_" + draw(digits, 1), lambda: "/".join(rng.choice(common) for _ in range(4)) + "/" + draw(digits, 4), lambda: "v" + ".".join(draw(digits, 2) for _ in range(7)), lambda: "".join(rng.choice(common).capitalize() for _ in range(4)) + draw(digits, 1)])(), f"{left} "
        out.append((value, before[-REACH:], (right if right.startswith("@") else " " + right)[:REACH], path, label))
    return out


def fit(findings=None, vocabulary: str | None = None) -> Forest:
    """A forest from rows (secret, before, after, path, label), generated ones by default, and the path of a vocabulary
    file on the driver, for the dictionary."""
    rows = labelled_findings() + labelled_keys() + labelled_assignments() + labelled_formats() if findings is None else list(findings)
    words = dictionary(vocabulary)
    trained = train(np.array([features(*r[:4], words) for r in rows]), np.array([float(r[4]) for r in rows]))
    return Forest(trained.trees, words)


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(doc_id, start, length, kind, score, is_secret) for each candidate of each whole text.

    Offsets count code points. score is the share of true findings in the forest's leaves; is_secret says whether it
    reaches threshold. Null and empty texts have no candidates; a null path is empty. Repeated rows, and rows that share
    an id, are scanned each on its own. Other columns are ignored. An empty table gives an empty result.
    """
    shared = session(docs).sparkContext.broadcast(forest or fit())  # bounded by the trees' number and depth and the dictionary

    def run(it):
        model = shared.value
        for batch in slices(it):
            ids, texts, paths = (batch.column(i).to_pylist() for i in range(3))
            rows, x = [], []
            for key, text, path in zip(ids, texts, paths, strict=True):
                for s, e, kind in candidates(text or ""):
                    rows.append((key, s, e - s, kind))
                    x.append(features(text[s:e], text[max(0, s - REACH) : s], text[e : e + REACH], path or "", model.words))
            score = model.predict(np.array(x)).round(6) if x else np.empty(0)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(score), pa.array(score >= threshold)], names=["doc_id", "start", "length", "kind", "score", "is_secret"])

    path = F.col(path_col).cast("string") if path_col else F.lit("")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), path.alias("path"))
    return src.mapInArrow(run, "doc_id long, start long, length long, kind string, score double, is_secret boolean")


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """docs with a placeholder in the place of each secret in the text; everything else stays as it is.

    A null text stays null and an empty one empty; a null path is empty. Every row is read on its own, repeated ones and
    ones without an id too. An empty table gives an empty result.
    """
    shared = session(docs).sparkContext.broadcast(forest or fit())

    @F.pandas_udf("string")
    def clean(texts, paths):
        import pandas as pd

        model, out = shared.value, []
        for text, path in zip(texts, paths, strict=True):
            found = list(candidates(text)) if text else []
            if found:
                x = np.array([features(text[s:e], text[max(0, s - REACH) : s], text[e : e + REACH], path or "", model.words) for s, e, _ in found])
                at, parts = 0, []
                for (s, e, _), p in zip(found, model.predict(x), strict=True):
                    if p >= threshold:
                        parts += [text[at:s], PLACEHOLDER]
                        at = e
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    path = F.col(path_col).cast("string") if path_col else F.lit("")
    return docs.withColumn(text_col, clean(F.col(text_col).cast("string"), path))
