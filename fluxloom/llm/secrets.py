"""Secret scans: fixed patterns and an assignment-aware lexer.

The lexer reads source and configuration syntax (`name = literal`, `name: literal`, `"name": literal`, `name := literal`,
`name => literal`, `export NAME=literal`, `env["NAME"] = literal`, `setName("literal")`, `<name>literal</name>`) into name-literal pairs, propagates constants (`x = "…"` and later
`password = x`, also through further names) and scores each literal by how sensitive the names are that it reaches.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SpanIndex, id_text, map_texts

# Fixed values of the contract.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

#: Weight of a name's parts; the parts are the runs of letters, camel case split.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
             "credentials": 0.9, "bearer": 0.9, "auth": 0.7, "authorization": 0.8, "private": 0.6, "signing": 0.6, "encryption": 0.6,
             "access": 0.5, "api": 0.5, "client": 0.3, "key": 0.5, "salt": 0.5, "cookie": 0.5, "session": 0.4, "dsn": 0.6, "jwt": 0.9}
PLACEHOLDERS = ("changeme", "example", "placeholder", "xxxx", "your", "none", "null", "true", "false", "todo", "redacted")
LEAST_SCORE, LEAST_LENGTH = 1.5, 6
#: Least weight of a name whose bare value of letters only counts as a literal.
SURE_NAME = 0.9

# Possessive, and a name starts with its run of characters only, so that names and literals of any length take linear time.
_PAIR = re.compile(r"""(?a)(?:(["'])|(?<![A-Za-z0-9_.-])[0-9.-]*+)([A-Za-z_][A-Za-z0-9_.-]*+)(?(1)\1)\]?+\ *+(?::=|=>|=(?!=)|:(?![:/]))\ *+
                       (?:"([^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|'([^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'|([A-Za-z0-9_+/.=$@!%^&*~-]+))""", re.X)
#: A call whose first argument is a quoted literal (`setPassword("…")`), and an element that holds text only.
_CALL = re.compile(r"""(?a)(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*+)\(\x20*+(?:"([^"\\\n]*+)"|'([^'\\\n]*+)')""")
_TAG = re.compile(r"(?a)<([A-Za-z_][A-Za-z0-9_.-]*+)>([^<>\n]++)</\1>")
#: A line that is nothing but name=letters, as in env and ini files, or name: letters with a name that no prose has.
_BARE_LINE = re.compile(r"""(?am)^[\x20\t]*+(?:export\x20++)?(?:[A-Za-z_][A-Za-z0-9_.-]*+\x20*+=|(?=[A-Za-z]*+[0-9_.-])[A-Za-z_][A-Za-z0-9_.-]*+:)
                            \x20*+([A-Za-z]++)[\x20\t]*+\r?$""", re.X)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_NAME = re.compile(r"(?a)[A-Za-z_][A-Za-z0-9_.]*\Z")


def name_weight(name: str) -> float:
    """How sensitive a target name is: the sum over its parts, two at most counting together (`api_key`)."""
    parts = [p.lower() for p in _PART.findall(name)]
    return min(1.5, sum(SENSITIVE.get(p, 0.0) for p in parts))


def literal_score(name: float, literal: str) -> float:
    """The name's weight and up to one more for length, kinds of characters and entropy; placeholders score nothing."""
    low = literal.lower()
    if len(literal) < LEAST_LENGTH or name <= 0 or any(p in low for p in PLACEHOLDERS) or len(set(literal)) < 4:
        return 0.0
    counts = Counter(literal)
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    kinds = any(c.isdigit() for c in literal) + any(c.isalpha() for c in literal) + any(not c.isalnum() for c in literal)
    return name + min(1.0, entropy / 4) * 0.5 + 0.25 * (kinds > 1) + 0.25 * (len(literal) >= 12)


def lex(text: str) -> list[tuple[str, str, int, int, bool]]:
    """(name, literal, start, end, quoted) of every assignment, in the order of the text; code points."""
    out = []
    for m in _PAIR.finditer(text):
        group = next(g for g in (3, 4, 5) if m.group(g) is not None)
        out.append((m.group(2), m.group(group), m.start(group), m.end(group), group < 5))
    if "(" in text:
        out += [(m.group(1), m.group(m.lastindex), m.start(m.lastindex), m.end(m.lastindex), True) for m in _CALL.finditer(text)]
    if "</" in text:
        out += [(m.group(1), m.group(2), m.start(2), m.end(2), True) for m in _TAG.finditer(text)]
    return sorted(out, key=lambda pair: pair[2:4])


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through constants, with a score of LEAST_SCORE or more.

    A bare word that names an earlier constant stands for that constant's literal; the last assignment before counts. Any
    other bare word of letters is a literal only after a name of weight SURE_NAME or more on a line of nothing else.
    """
    if not any(c in text for c in "=:(<"):
        return []
    constants: dict[str, tuple[str, int, int]] = {}
    best: dict[tuple[int, int], float] = {}
    bare = {m.start(1) for m in _BARE_LINE.finditer(text)} if "=" in text or ":" in text else set()
    for name, literal, start, end, quoted in lex(text):
        source = (literal, start, end)
        if not quoted and literal in constants:
            source = constants[literal]
        elif not quoted and _NAME.match(literal) and not any(c.isdigit() for c in literal):
            if start not in bare or name_weight(name) < SURE_NAME:
                continue  # a bare word of letters is a name or prose, no literal
        constants[name] = source
        score = literal_score(name_weight(name), source[0])
        if score >= LEAST_SCORE:
            best[source[1:]] = max(score, best.get(source[1:], 0.0))
    return sorted(best)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlap within a kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def join_spans(spans: list[tuple[int, str, int]], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then by the order of *kinds*."""
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], kinds.index(s[1]), s[2])))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per row.

    Spans are `kind:start:end` in code points, end exclusive; kind `literal` is what the lexer adds, unless a pattern of
    the base covers the literal already. A NULL or empty text has no spans. Repeated rows are each scanned.
    """
    def work(keys: list, texts: list) -> dict:
        n, digest, spans = {k: [] for k in KINDS[:3]}, [], []
        for text in texts:
            base = base_spans(text) if text else []
            index = SpanIndex([(a, b) for a, _, b in base])
            more = [(a, "literal", b) for a, b in (literal_spans(text) if text else []) if not index.covers(a, b)]
            for k in n:
                n[k].append(sum(s[1] == k for s in base))
            digest.append(hashlib.sha256(join_spans(base, KINDS).encode()).hexdigest())
            spans.append(join_spans(base + more, KINDS))
        return {"doc_id": pa.array(keys, pa.int64()), **{f"n_{k}": pa.array(v, pa.int64()) for k, v in n.items()},
                "base_sha256": pa.array(digest, pa.string()), "spans": pa.array(spans, pa.string())}

    return map_texts(id_text(docs, id_col, text_col),
                     "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", work)
