"""Personal data by weak supervision.

1. Candidates: the base patterns (email, ip, card, phone) and looser shapes (digit groups, handles, words after a
   title, runs of capitalised words with a given name).
2. Labelers vote 1 (personal), 0 (not) or -1 (no opinion) on each candidate: pattern labelers, gazetteer labelers and
   context labelers.
3. Candidates with the same shape, votes and features are counted over the whole corpus: a table whose size depends on
   the number of labelers and features, not on the documents. Expectation-maximisation on these counts estimates each
   labeler's hit and false-alarm rates per shape and the share of personal spans.
4. A logistic span classifier is trained on the same counts against the posteriors; it sees only features, no votes.
5. The classifier decides the candidates that no base pattern holds; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import SpanIndex, id_text

# Fixed values of the contract.
# What may stand before and after the @ of an address; `emails` puts them together.
MAILBOX = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Runs of digits are read from their heads and never given back, so a long run takes linear time; the matches are the same.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "number", "handle", "name")

_NUMBER = re.compile(r"""(?<![\w.@-])(?:
    [0-9]{12,19}(?![\w-])                                                          # a number in one run
    | \+?[0-9]{1,3}[\x20.-]?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])  # country, (area), number
    | [0-9]{4}(?:[\x20-][0-9]{4}){2,3}(?:[\x20-][0-9]{1,4})?(?![\w-])               # groups of four
    | \(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,5}){1,4}(?![\w-])
    | [0-9]{7,11}(?![\w-]))""", re.X)
_HANDLE = re.compile(r"(?<![\w@.])@[A-Za-z0-9_]{3,30}(?![\w@])")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "Don", "Doña")
_NAMED = re.compile(rf"\b({'|'.join(TITLES)})\.? ([^\W\d_]+)(?: ([^\W\d_]+))?")
_WORD = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*+(?:['’-][^\W\d_]++)*+"
# A run of hyphened parts is tried once, from its first capital on: what follows the run is the same for all its parts.
_CAPITALS = re.compile(rf"(?<!\w)(?<![^\W\d_]['’-])(?:[a-zß-öø-ÿ][^\W\d_]*+['’-])*+({_WORD}(?:(?: [A-Z]\.)* {_WORD})+)")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[^0-9]+")

# Gazetteers and context words: fixed values.
PROVIDERS = {"gmail", "yahoo", "hotmail", "outlook", "icloud", "proton", "protonmail", "gmx", "aol", "mail", "web"}
ROLE_ADDRESSES = {"info", "admin", "support", "contact", "noreply", "no-reply", "webmaster", "postmaster", "sales", "help", "abuse"}
GIVEN_NAMES = {"james", "mary", "john", "anna", "maria", "jose", "juan", "carlos", "peter", "hans", "klaus", "marie", "jean", "pierre",
               "michel", "sophie", "david", "sarah", "thomas", "laura", "paul", "julia", "michael", "linda", "robert", "emma"}
PHONE_WORDS = ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "teléfono", "téléphone", "handy", "whatsapp")
CARD_WORDS = ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "credit", "iban", "account", "konto")
ID_WORDS = ("ssn", "passport", "social", "dni", "nie", "ausweis", "pass", "sécurité", "identity", "tax", "steuer")
MAIL_WORDS = ("mail", "email", "e-mail", "contact", "correo", "courriel", "write", "kontakt")
NOT_PERSONAL = ("version", "page", "pages", "isbn", "issn", "vol", "no.", "nr.", "chapter", "section", "release", "port", "figure", "table",
                "$", "€", "£", "%", "usd", "eur", "kg", "km", "copyright", "©")

LABELERS = ("pattern", "checksum", "gazetteer", "near_same", "context_for", "context_against")
FEATURES = ("bias", "n_digits", "groups", "long_run", "luhn", "plus", "at_sign", "dots", "capital", "known_name", "year_like", "leading_zero")
WINDOW = 48
THRESHOLD = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses without overlap, from one @ to the next; the mailbox is the whole run before it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        head = done + len(text[done:at].rstrip(MAILBOX))
        host = HOST.match(text, at + 1) if head < at else None
        if host:
            yield head, host.end()
        done = host.end() if host else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the four patterns; a match that fails its test is dropped and not tried again."""
    out = []
    if "@" in text:
        out += [(a, "email", b) for a, b in emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), "ip", m.end()))
    for m in CARD.finditer(text) if _DIGIT.search(text) else ():
        if m.end() - m.start() >= 12 and 12 <= len(d := _DIGITS.sub("", m.group())) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((m.start(), "phone", m.end()))
    return out


def _has_given_name(words: str) -> bool:
    return any(p in GIVEN_NAMES for p in _LETTERS.findall(words.lower()))


def name_runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of two capitalised words or more, from their first given name on; whole if that is the last word."""
    for m in _CAPITALS.finditer(text):
        if not _has_given_name(m.group(1)):
            continue
        runs: list[list[tuple[int, int]]] = [[]]
        for w in re.finditer(r"[^ ]+", m.group(1)):
            if w.group()[0].isupper():
                runs[-1].append(w.span())
            else:  # letters without a lower-case form in the pattern
                runs.append([])
        for run in runs:
            known = next((k for k, (a, b) in enumerate(run) if _has_given_name(m.group(1)[a:b])), None)
            if known is not None and len(run) > 1:
                yield m.start(1) + run[known if known < len(run) - 1 else 0][0], m.start(1) + run[-1][1]


def loose_spans(text: str) -> list[tuple[int, str, int]]:
    """Candidates of looser shapes, leftmost per kind."""
    out = [(m.start(), "number", m.end()) for m in _NUMBER.finditer(text)] if _DIGIT.search(text) else []
    if "@" in text:
        out += [(m.start(), "handle", m.end()) for m in _HANDLE.finditer(text)]
    if any(t in text for t in TITLES):
        out += [(m.start(2), "name", m.end()) for m in _NAMED.finditer(text)]
    titled = [(a, b) for a, k, b in out if k == "name"]
    at = 0
    for a, b in name_runs(text):
        while at < len(titled) and titled[at][1] <= a:
            at += 1
        if at == len(titled) or titled[at][0] >= b:
            out.append((a, "name", b))
    return out


def votes_and_features(text: str, start: int, kind: str, end: int, base: SpanIndex) -> tuple[list[int], list[int]]:
    """Votes of LABELERS and binned FEATURES of one candidate."""
    span, before = text[start:end], text[max(0, start - WINDOW):start].lower()
    digits = _DIGITS.sub("", span)
    near = before.split()[-6:]
    has = lambda ws: any(w in x for x in near for w in ws)
    sums = kind in ("card", "number") and 12 <= len(digits) <= 19
    low = span.lower()
    known = kind == "name" and _has_given_name(span)
    pattern = 1 if kind in BASE else 0 if kind == "number" and len(digits) < 7 else -1
    gazetteer = -1
    if kind == "email":
        user, _, host = low.partition("@")
        gazetteer = 0 if user in ROLE_ADDRESSES else 1 if host.split(".")[0].rstrip("0123456789") in PROVIDERS else -1
    elif kind == "name":
        gazetteer = int(known)
    elif kind == "number":
        gazetteer = 0 if re.fullmatch(r"(19|20)[0-9]{2}[ .-](19|20)?[0-9]{2}.*", span) else -1
    for_words = {"phone": PHONE_WORDS, "card": CARD_WORDS, "email": MAIL_WORDS, "number": PHONE_WORDS + CARD_WORDS + ID_WORDS}.get(kind, ())
    votes = [pattern, int(luhn(digits)) if sums else -1, gazetteer,
             1 if base.near(start, end, WINDOW) else -1,
             1 if has(for_words) else -1, 0 if has(NOT_PERSONAL) else -1]
    groups = len(re.findall(r"[0-9]+", span))
    features = [1, min(len(digits), 20) // 3, min(groups, 5), int(max(map(len, re.findall(r"[0-9]+", span)), default=0) >= 7), int(votes[1] == 1),
                int("+" in span), int("@" in span), min(span.count("."), 3), int(span[:1].isupper()), int(known),
                int(bool(re.match(r"(19|20)[0-9]{2}\b", span))), int(digits[:1] == "0")]
    return votes, features


def candidate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and its candidates as structs (start, end, kind, in_base, key).

    `key` holds votes and features as text; rows with equal keys are alike for every later step.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("in_base", pa.bool_()), ("key", pa.string())])
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                spans = []
                if text:
                    base = base_spans(text)
                    index = SpanIndex([(a, b) for a, _, b in base])
                    more = [s for s in loose_spans(text) if not index.overlaps(s[0], s[2])]
                    for a, k, b in base + more:
                        votes, features = votes_and_features(text, a, k, b, index)
                        spans.append({"start": a, "end": b, "kind": k, "in_base": k in BASE,
                                      "key": f"{k}|{','.join(map(str, votes))}|{','.join(map(str, features))}"})
                out.append(spans)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "spans": pa.array(out, pa.list_(kind_of))})

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, spans array<struct<start:int,end:int,kind:string,in_base:boolean,key:string>>")


class SpanModel:
    """Labeler reliabilities by expectation-maximisation and a logistic classifier of the features."""

    def __init__(self, rounds: int = 50, l2: float = 1e-3):
        self.rounds, self.l2 = rounds, l2
        self.rates: dict[str, np.ndarray] = {}  # kind -> [labeler, class, vote 0 / 1 / none]
        self.share: dict[str, float] = {}
        self.weights = np.zeros(0)

    @staticmethod
    def _parse(key: str) -> tuple[str, np.ndarray, np.ndarray]:
        kind, votes, features = key.split("|")
        return kind, np.array(votes.split(","), dtype=int), np.array(features.split(","), dtype=int)

    def _design(self, kinds: list[str], features: np.ndarray) -> np.ndarray:
        """One indicator per kind, and each feature scaled to at most 1, also within the loose kinds."""
        one = np.array([[k == x for x in KINDS] for k in kinds], dtype=float).reshape(len(kinds), len(KINDS))
        scaled = features / np.array([1, 6, 5, 1, 1, 1, 1, 3, 1, 1, 1, 1])
        loose = one[:, len(BASE):].sum(1, keepdims=True)
        return np.hstack([one, scaled, scaled * loose])

    def fit(self, counted: list[tuple[str, int]]) -> "SpanModel":
        """From (key, count) of the whole corpus, in any order; no rows leave the prior alone."""
        if not counted:
            return self
        counted = sorted(counted)
        kinds, votes, features = zip(*(self._parse(k) for k, _ in counted))
        votes, features, n = np.array(votes), np.array(features), np.array([c for _, c in counted], dtype=float)
        post = np.zeros(len(n))
        for kind in sorted(set(kinds)):
            at = np.array([k == kind for k in kinds])
            post[at] = self._em(kind, votes[at], n[at])
        self.weights = self._logistic(self._design(list(kinds), features), post, n)
        return self

    def _em(self, kind: str, votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Votes are independent given the class; a weak prior says that a vote is right four times of five."""
        prior = np.ones((len(LABELERS), 2, 3))
        prior[:, 0, 0] = prior[:, 1, 1] = 4.0
        rates, share = prior / prior.sum(2, keepdims=True), 0.5
        column = np.where(votes < 0, 2, votes)
        at = np.arange(len(LABELERS))
        for _ in range(self.rounds):
            ll = [np.log(rates[at, c, column]).sum(1) + np.log(share if c else 1 - share) for c in (0, 1)]
            # silence is shared by both classes: a labeler without opinion moves nothing
            for j in at:
                quiet = column[:, j] == 2
                for c in (0, 1):
                    ll[c] = ll[c] - np.where(quiet, np.log(rates[j, c, 2]), 0.0)
            post = 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -500, 500)))
            share = float(np.clip((1 + (post * n).sum()) / (2 + n.sum()), 1e-3, 1 - 1e-3))
            counts = prior.copy()
            for c, weight in ((0, (1 - post) * n), (1, post * n)):
                for j in at:
                    counts[j, c] += np.bincount(column[:, j], weights=weight, minlength=3)
            rates = counts / counts.sum(2, keepdims=True)
        self.rates[kind], self.share[kind] = rates, share
        return post

    def _logistic(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Newton steps on the weighted logistic loss with a small ridge."""
        w, n = np.zeros(x.shape[1]), n / n.sum()
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (n * (p - y)) + self.l2 * w
            hess = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + self.l2 * np.eye(len(w))
            move = np.linalg.solve(hess, grad)
            w = w - move
            if np.abs(move).max() < 1e-8:
                break
        return w

    def probability(self, key: str) -> float:
        if not len(self.weights):
            return 0.5
        kind, _, features = self._parse(key)
        return float(1 / (1 + np.exp(-np.clip(self._design([kind], features[None])[0] @ self.weights, -30, 30))))


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans per row; spans are `kind:start:end` in code points.

    A NULL or empty text has no spans; repeated rows are each scanned. Counts for the model cover all rows; the table of
    distinct keys that reaches the driver is bounded by shapes, votes and bins.
    """
    found = cut_lineage(candidate_spans(docs, id_col, text_col), "pii-candidates")
    counted = found.select(F.explode("spans.key").alias("key")).groupBy("key").count().collect()
    model = SpanModel().fit([(r["key"], r["count"]) for r in counted])
    chosen = {r["key"] for r in counted if model.probability(r["key"]) > threshold}
    shipped = found.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, take = {k: i for i, k in enumerate(KINDS)}, shipped.value
        for batch in batches:
            n, digest, spans = {k: [] for k in BASE}, [], []
            for row in batch.column(1).to_pylist():
                row = sorted(row, key=lambda s: (s["start"], order[s["kind"]], s["end"]))
                base = [s for s in row if s["in_base"]]
                for k in BASE:
                    n[k].append(sum(s["kind"] == k for s in base))
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined([s for s in row if s["in_base"] or s["key"] in take]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **{f"n_{k}": pa.array(v, pa.int64()) for k, v in n.items()},
                                              "base_sha256": pa.array(digest, pa.string()), "spans": pa.array(spans, pa.string())})

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _joined(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
