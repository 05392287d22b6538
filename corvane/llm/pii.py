"""PII by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are stretches that hold a digit or an at sign, and what is assigned to a password, token or
the like, with or without one. Regex, gazetteer and context labelers each vote for a kind, for "none", or abstain. Expectation-maximisation over the counts of all vote
patterns estimates every labeler's confusion matrix and the kinds' shares; the resulting label
probabilities train a softmax classifier on the span's shape and context, which makes the result.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import kernel
from corvane.llm.tables import keep, table

KINDS = ("none", "email", "phone", "ip", "card", "secret", "iban", "national_id")
K = len(KINDS)
ABSTAIN = -1
FEATURES, MAX_TRAIN, CONTEXT = 256, 20_000, 40

_TRIGGER = re.compile(r"[0-9@]")
_ASSIGN = r"(?:token|secret|passw(?:or)?d|passwort|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|mot de passe|contraseña)[\w\-]{0,40}+[\"'`\]]{0,3}(?:\s{0,3}(?::=|=>|=|:)\s{0,3}|\s+(?:is|ist|est|es)\s+)"
#: One of these is in the lower case of every text that _ASSIGNED matches.
_ASSIGN_PARTS = ("token", "secret", "passw", "passphrase", "pwd", "key", "credential", "auth", "mot de passe", "contraseña")
_ASSIGNED = re.compile(_ASSIGN + r"""(?:(?P<q>["'`])(?P<s>[^\s"'`]{4,}+)|(?P<v>(?![A-Z]{2}[0-9]{2}\s)[^\s"'`,;()\[\]{}<>@]{4,}+))""", re.I)
_LETTER, _DIGIT, _BLANK = re.compile(r"[a-zA-Z]"), re.compile(r"[0-9]"), re.compile(r"\s")
_ASSIGN_LEFT = re.compile(_ASSIGN + r"[\"'`]?$", re.I)
_IP6 = r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})"
_CANDIDATE = re.compile(
    r"""(?P<q>["'`])(?P<s>[A-Za-z0-9+/_=.\-]{16,}+)(?P=q)"""  # a quoted key
    r"|[\w.+\-]{1,64}@[\w\-]+(?:\.[\w\-]+)+"
    rf"|(?<![\w:.]){_IP6}(?![\w:])"
    r"|[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?\b"
    r"|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"
    r"|\b[0-9]{12,19}\b"
    r"|\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?[ .\-/]?[0-9]{3}[ .\-]?[0-9]{3,4}\b"
    r"|[+(]?[0-9][0-9().\- /]{2,}[0-9]"
    r"|(?<![A-Za-z0-9_\-])-*+(?P<k>[A-Za-z0-9_][A-Za-z0-9_\-]{15,}+)"
    r"|\b[0-9][0-9.,:]*"
)


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _vote(kind: str) -> int:
    return KINDS.index(kind)


_IPV6 = re.compile(_IP6)
_NOT_SECRET = re.compile(r"(?i)none|null|true|false|undefined|string|str|text|bytes|number|required|optional|default|example|changeme|todo|(.)\1*|[$%<{].*|.*(token|secret|password|passwd|api[_-]?key|your|xxx|\*\*\*|\.\.\.).*")
_EMAIL = re.compile(r"[\w.+\-]+@[\w\-]+(\.[\w\-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")
_PHONE = re.compile(r"(\+[0-9]{1,3}[ .\-]?)?(\([0-9]{2,4}\)|[0-9]{2,4})[ .\-/]?[0-9]{3}[ .\-]?[0-9]{3,4}")
_CARD = re.compile(r"[0-9]{4}([ \-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_HEX = re.compile(r"[0-9a-fA-F]{20,}")
_KEY = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=\-]{20,}")
_VERSION = re.compile(r"[0-9]{1,4}([.,:][0-9]{1,4}){0,2}\.?")
_TLDS = frozenset("com org net edu gov int io de fr es uk it nl eu us ch at be info biz co me dev app".split())
_SECRET_WORDS = re.compile(r"(token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|credential|bearer|auth|mot de passe|passwort|contraseña)\W{0,5}$", re.I)
_CALL_WORDS = re.compile(r"(tel|phone|call|fax|mobile|cell|whatsapp|telefon|anruf|appel|tél|teléfono|llam)\w*\W{0,5}$", re.I)
_MAIL_WORDS = re.compile(r"(e-?mail|mail|contact|write to|correo|courriel)\w*\W{0,5}$", re.I)
_IP_WORDS = re.compile(r"(\bip|address|host|server|from|adresse|dirección)\W{0,5}$", re.I)
_CARD_WORDS = re.compile(r"(card|visa|mastercard|amex|credit|kreditkarte|carte|tarjeta)\w*\W{0,5}$", re.I)
_PLAIN_WORDS = re.compile(r"(version|licen[sc]e\w*|apache|cc[ -]by\S*|isbn|chapter|page|section|figure|table|seite|kapitel|página|vol|no|nr)\W{0,5}$", re.I)


def _regex(pattern: re.Pattern, kind: str, check: Callable[[str], bool] = lambda s: True) -> Callable:
    k = _vote(kind)
    return lambda s, left, right: k if pattern.fullmatch(s) and check(s) else ABSTAIN


def _context(pattern: re.Pattern, kind: str) -> Callable:
    k = _vote(kind)
    return lambda s, left, right: k if pattern.search(left) else ABSTAIN


def _octets(s: str) -> bool:
    return all(int(x) <= 255 and (x == "0" or x[0] != "0") for x in s.split("."))


def _ip6(s: str) -> bool:
    try:
        return ipaddress.ip_address(s).version == 6
    except ValueError:
        return False


def _assigned(s: str, left: str, right: str) -> int:
    """A value assigned to a password or the like; a gazetteer of types, names and stand-ins votes none."""
    if not _ASSIGN_LEFT.search(left) or "@" in s or not any(c.isalpha() for c in s):
        return ABSTAIN
    return _vote("none") if _NOT_SECRET.fullmatch(s) else _vote("secret")


def _domain(s: str, left: str, right: str) -> int:
    if "@" not in s:
        return ABSTAIN
    return _vote("email") if s.rstrip(".").rpartition(".")[2].lower() in _TLDS else _vote("none")


def _network(s: str, left: str, right: str) -> int:
    """Gazetteer of special address blocks."""
    if not _IP.fullmatch(s):
        return ABSTAIN
    return _vote("none") if s.startswith(("0.", "127.", "255.")) or not _octets(s) else _vote("ip")


def _issuer(s: str, left: str, right: str) -> int:
    """Gazetteer of card issuers' first digits; votes with Luhn's sum only for the usual lengths."""
    d = _digits(s)
    if len(s) - len(d) > 4 or not 13 <= len(d) <= 19:
        return ABSTAIN
    return _vote("card") if d[0] in "3456" or len(d) == 16 and luhn(d) else ABSTAIN


def _calling_code(s: str, left: str, right: str) -> int:
    d = _digits(s)
    return _vote("phone") if s[:1] == "+" and 8 <= len(d) <= 15 else ABSTAIN


def _shape(s: str, left: str, right: str) -> int:
    """Votes by the number of digits alone."""
    d = len(_digits(s))
    letters = sum(c.isalpha() for c in s)
    if "@" in s:
        return _vote("email") if letters else _vote("none")
    if _IPV6.fullmatch(s):
        return _vote("ip")
    if letters:
        return _vote("secret") if d >= 4 and len(s) >= 20 else ABSTAIN
    if "." in s and s.count(".") == 3 and d <= 12:
        return _vote("ip")
    return _vote("none") if d < 7 else _vote("phone") if d <= 12 else _vote("card") if d <= 19 else _vote("none")


def _short(s: str, left: str, right: str) -> int:
    return _vote("none") if _VERSION.fullmatch(s) and len(_digits(s)) <= 6 else ABSTAIN


def _entropy(s: str, left: str, right: str) -> int:
    if len(s) < 20 or not any(c.isalpha() for c in s) or "@" in s or _IPV6.fullmatch(s):
        return ABSTAIN
    p = np.unique(list(s), return_counts=True)[1] / len(s)
    return _vote("secret") if -(p * np.log2(p)).sum() >= 3 else _vote("none")


LABELERS: dict[str, Callable[[str, str, str], int]] = {
    "re_email": _regex(_EMAIL, "email"),
    "re_ip": _regex(_IP, "ip", _octets),
    "re_ip6": _regex(_IPV6, "ip", _ip6),
    "re_phone": _regex(_PHONE, "phone", lambda s: 9 <= len(_digits(s)) <= 15 and len(_digits(s)) != len(s)),
    "re_card": _regex(_CARD, "card"),
    "re_iban": _regex(_IBAN, "iban"),
    "re_ssn": _regex(_SSN, "national_id"),
    "re_hex": _regex(_HEX, "secret", lambda s: any(c.isalpha() for c in s)),
    "re_key": _regex(_KEY, "secret"),
    "gaz_domain": _domain,
    "gaz_network": _network,
    "gaz_issuer": _issuer,
    "gaz_calling_code": _calling_code,
    "ctx_secret": _context(_SECRET_WORDS, "secret"),
    "ctx_assigned": _assigned,
    "ctx_call": _context(_CALL_WORDS, "phone"),
    "ctx_mail": _context(_MAIL_WORDS, "email"),
    "ctx_ip": _context(_IP_WORDS, "ip"),
    "ctx_card": _context(_CARD_WORDS, "card"),
    "ctx_plain": _context(_PLAIN_WORDS, "none"),
    "shape": _shape,
    "short": _short,
    "entropy": _entropy,
}


def _assigned_spans(text: str) -> list[tuple[int, int]]:
    """What is assigned to a password or the like; types, names and stand-ins for a value are not."""
    out, at = [], 0
    while m := _ASSIGNED.search(text, at):
        a, b = m.span("s") if m["s"] else m.span("v")
        if m["s"]:
            good = text[b : b + 1] == m["q"]
        else:
            good = bool(_DIGIT.search(text, a, b) and _LETTER.search(text, a, b)) and text[b : b + 1] not in ("(", "[", "@")
        if good and not _NOT_SECRET.fullmatch(text, a, b):
            out.append((a, b))
        elif b - a < 200:  # the value may be the name of the next assignment; a longer one is passed over
            b = a
        at = b
    return out


def _around(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Blank-separated stretches around the at signs that lie in no span; spans ascend."""
    stray, k, at = [], 0, text.find("@")
    while at >= 0:
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        if k == len(spans) or spans[k][0] > at:
            stray.append(at)
        at = text.find("@", at + 1)
    if not stray:
        return []
    blanks = [-1, *(m.start() for m in _BLANK.finditer(text)), len(text)]
    out: list[tuple[int, int]] = []
    for at in stray:
        k = bisect_left(blanks, at)
        a, b = blanks[k - 1] + 1, blanks[k]
        n = bisect_left(spans, (at, at))  # the next spans on both sides bound it
        a, b = max(a, spans[n - 1][1] if n else 0), min(b, spans[n][0] if n < len(spans) else b)
        if not out or out[-1] != (a, b):
            out.append((a, b))
    return out


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans (from, to) that may be private; in time that follows the text's length."""
    if not text:
        return []
    out = []
    small = text.lower()
    if any(w in small for w in _ASSIGN_PARTS):
        out = _assigned_spans(text)
    if _TRIGGER.search(text):
        given = iter([*out, (len(text), len(text))])
        low, high = next(given)
        found = []

        def add(a: int, b: int) -> None:
            nonlocal low, high
            while b > a and text[b - 1] in ".,;:!?-/ ":
                b -= 1
            while high <= a and high < len(text):
                low, high = next(given)
            if b > a and (b <= low or a >= high) and _TRIGGER.search(text, a, b):
                found.append((a, b))

        for m in _CANDIDATE.finditer(text):
            add(*(m.span("s") if m["s"] else m.span("k") if m["k"] else m.span()))
        out = sorted(out + found)
        if "@" in text:
            found = []
            for a, b in _around(text, out):
                while b > a and text[b - 1] in ".,;:!?-/ ":
                    b -= 1
                if b > a:
                    found.append((a, b))
            out += found
    return sorted(out)


def votes(text: str, a: int, b: int) -> list[int]:
    s, left, right = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    return [f(s, left, right) for f in LABELERS.values()]


def shape(s: str) -> str:
    """Runs of digits, small and capital letters by kind and length (up to 9)."""
    return re.sub(r"[0-9]+|[a-z]+|[A-Z]+", lambda m: ("9" if m[0][0].isdigit() else "a" if m[0][0].islower() else "A") + str(min(len(m[0]), 9)), s)


def features(s: str, left: str) -> list[int]:
    """Places of the features that the span has, of FEATURES: its shape's pieces and their pairs,
    lengths, marks, and the last word before it."""
    sh = shape(s)
    parts = re.findall(r"[9aA][0-9]|.", sh)
    names = [f"p{p}" for p in {*parts}] + [f"b{x}{y}" for x, y in {*zip(parts, parts[1:])}]
    d = len(_digits(s))
    names += [f"d{min(d, 20)}", f"l{min(len(s) // 4, 16)}", f"at{'@' in s}", f"dots{min(s.count('.'), 4)}", f"al{any(c.isalpha() for c in s)}", f"plus{s[:1] == '+'}"]
    if ":" in s:
        names.append(f"colons{min(s.count(':'), 8)}{bool(_IPV6.fullmatch(s))}")
    if _ASSIGN_LEFT.search(left):
        names.append(f"assigned{bool(_NOT_SECRET.fullmatch(s))}")
    word = re.findall(r"\w+", left[-CONTEXT:])[-1:]
    mark = left.rstrip()[-1:]
    names += [f"m{mark}" if not mark.isalnum() else "m", f"w{word[0].lower()}" if word and _known(word[0]) else "w"]
    return sorted({_place(n) for n in names})


@lru_cache(1 << 16)
def _place(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % FEATURES


def _known(word: str) -> bool:
    return bool(re.fullmatch(r"(?i)token|secret|password|key|tel|phone|call|email|mail|ip|card|version|license|by|page", word))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, low, texts in ((b, low, texts) for b in batches for low, _, texts in kernel.chunks(b.column(1))):
        out: list[tuple] = []
        for row, text in enumerate(texts, low):
            for a, b in candidates(text):
                pattern = ",".join(map(str, votes(text, a, b)))
                out.append((row, a, b, pattern, features(text[a:b], text[max(0, a - CONTEXT) : a])))
        cols = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds))], ["doc_id", "start", "end", "pattern", "features"])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior by pattern, reliabilities [labeler, true kind, vote or abstain], shares of the kinds)
    of a Dawid-Skene model; patterns is (n, labelers) with votes or ABSTAIN. It starts from the
    majority; the first pass of smoothing favours a vote for the true kind."""
    n, m = patterns.shape
    counts = counts.astype(float)
    post = np.full((n, K), 0.1 / K)
    for k in range(K):
        post[:, k] += (patterns == k).sum(1)
    post /= post.sum(1, keepdims=True)
    prior_hits = np.full((K, K + 1), 0.1) + np.hstack([np.eye(K), np.ones((K, 1))])
    confusion, shares = np.zeros((m, K, K + 1)), np.full(K, 1 / K)
    seen = np.where(patterns == ABSTAIN, K, patterns)
    for _ in range(rounds):
        shares = (post * counts[:, None]).sum(0) + 1.0
        shares /= shares.sum()
        for j in range(m):
            c = prior_hits.copy()
            np.add.at(c.T, seen[:, j], post * counts[:, None])
            confusion[j] = c / c.sum(1, keepdims=True)
        log = np.log(shares)[None, :].repeat(n, 0)
        for j in range(m):
            log += np.log(confusion[j][:, seen[:, j]]).T
        log -= log.max(1, keepdims=True)
        new = np.exp(log)
        new /= new.sum(1, keepdims=True)
        moved = float(np.abs(new - post).max()) if n else 0.0
        post = new
        if moved < 1e-6:
            break
    return post, confusion, shares


def fit_softmax(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """(FEATURES + 1, K) weights of a softmax classifier for soft targets, by full-batch gradient steps
    with momentum; the last row is the bias."""
    w = np.zeros((x.shape[1] + 1, K))
    if not len(x):
        w[-1, 0] = 5
        return w
    z = np.hstack([x, np.ones((len(x), 1))])
    speed = np.zeros_like(w)
    weight = weight / weight.sum()
    for _ in range(rounds):
        p = z @ w
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed - rate * (z.T @ ((p - target) * weight[:, None]) + decay * w)
        w = w + speed
    return w


def _dense(features: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(features), FEATURES))
    for i, f in enumerate(features):
        x[i, f] = 1
    return x


def _classify(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            x = _dense(batch.column(4).to_pylist())
            p = np.hstack([x, np.ones((len(x), 1))]) @ w
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            kind = p.argmax(1)
            some = np.flatnonzero(kind != 0)
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(3)), pa.array([KINDS[k] for k in kind[some]], pa.string()), pa.array(np.round(p[some, kind[some]], 6))], ["doc_id", "start", "end", "kind", "p"])

    return run


def private_spans(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, start, end, kind, p): the spans that the classifier takes for private data, from
    character `start` to before `end`; kind is email, phone, ip, card, secret, iban or national_id.

    Votes are counted over all spans of all documents. The classifier learns from at most max_train
    distinct pairs of vote pattern and features, the most frequent ones, weighted by their counts.

    A candidate holds a digit or an at sign, or is assigned to a password, token or the like (quoted
    values from 4 characters; unquoted ones with a letter and a digit). Names of persons, postal
    addresses and secrets that are neither are not looked for. Spans of any length are judged whole; of
    what surrounds one, CONTEXT characters to each side.

    Null and empty texts have no spans. Rows with a null doc_id are searched like others. Repeated rows
    give repeated result rows. Texts are searched whole. Empty table: empty result. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    spans = keep(narrow.mapInArrow(_spans, "doc_id bigint, start bigint, end bigint, pattern string, features array<int>"), "spans")
    counted = spans.groupBy("pattern").count().orderBy("pattern").toPandas()
    patterns = np.array([list(map(int, p.split(","))) for p in counted["pattern"]], int).reshape(len(counted), len(LABELERS))
    post, _, _ = expectation_maximisation(patterns, counted["count"].to_numpy())
    of = {p: q for p, q in zip(counted["pattern"], post)}
    pairs: pd.DataFrame = spans.groupBy("pattern", "features").count().orderBy(F.desc("count"), "pattern", F.col("features").cast("string")).limit(max_train).toPandas()
    w = fit_softmax(_dense(pairs["features"].tolist()), np.array([of[p] for p in pairs["pattern"]]).reshape(-1, K), np.sqrt(pairs["count"].to_numpy(float)))
    return spans.mapInArrow(_classify(spark.sparkContext.broadcast(w)), "doc_id bigint, start bigint, end bigint, kind string, p double")


def op4_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans(table(spark, sf_dir, "documents"))
