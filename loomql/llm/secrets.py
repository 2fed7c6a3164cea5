"""Operator 10. Secret scans by assignment-aware lexing.

Source and configuration syntax is lexed into pairs of name and literal: `name =
"x"`, `name := "x"`, `"name": "x"`, `name: x`, `NAME=x`, `name => 'x'`,
`<name>x</name>` are assignments; adjacent literals joined by `+` or `.` are one
literal; a name on the right stands for the literals that the same text last
gave it (constants are propagated, also through further names, and in `+`).
A literal's score adds how sensitive its target's name is (SENSITIVE, by the
parts of a name) to how random the literal looks (bits of entropy a character,
length, alphabet), less what marks placeholders, and LEAST of it is a secret.
Private-key blocks and keys of well-known shapes need no target.

Whole texts are lexed. Only texts with `=`, `:` or a well-known shape can hold a
pair, so the others are passed by without one.

Cases. Null and empty texts have no findings. A literal is reported where it
stands, once, with the highest score of the names it reaches; repeated rows each
have theirs. Very long texts are lexed in one pass, in time about linear. An
empty table gives no rows. Other columns, also of clashing names, are kept by
redact() and ignored by scan().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomql.llm.common import ship

LEAST = 5.0
SENSITIVE = {"password": 4, "passwd": 4, "passphrase": 4, "pwd": 3.5, "pass": 2.5, "secret": 4, "token": 3.5, "apikey": 4, "credential": 3.5, "credentials": 3.5, "privatekey": 4, "accesskey": 4, "secretkey": 4, "signingkey": 4, "encryptionkey": 4, "authorization": 3.5, "auth": 2.5, "bearer": 3.5, "key": 1.5, "cookie": 2, "session": 1.5, "salt": 1.5, "dsn": 2}
HARMLESS = {"public", "primary", "foreign", "id", "name", "path", "file", "url", "uri", "type", "length", "size", "count", "max", "min", "expires", "ttl", "field", "label", "hint", "checksum", "commit", "revision", "etag", "md5", "sha1", "sha256", "digest", "integrity", "color"}
SHAPES = r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|github_pat_[0-9A-Za-z_]{50}|xox[abprs]-[0-9A-Za-z-]{10}|sk_live_[0-9A-Za-z]{20}|AIza[0-9A-Za-z_-]{35}|glpat-[0-9A-Za-z_-]{20}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
MAY_HOLD = "[=:]|</|" + SHAPES
PLACEHOLDER = re.compile(r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|your[-_ ].*|change[-_]?me.*|example.*|placeholder.*|dummy.*|none|null|true|false|todo|redacted.*|\[redacted\])$")
LOOKUP = re.compile(r"(?:environ|getenv|process\.env|env\[|vault|config\.get|secrets\.)", re.I)
LINE_END = re.compile(r"[ \t]*(?:[\n;#]|$)")
LEX = re.compile(
    r"""
    (?P<shape>-----BEGIN\ [A-Z ]*PRIVATE\ KEY-----(?:[^-]|-(?!----))*(?:-----END\ [A-Z ]*PRIVATE\ KEY-----)?|\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[0-9A-Za-z]{36,}|\bgithub_pat_[0-9A-Za-z_]{50,}|\bxox[abprs]-[0-9A-Za-z-]{10,}|\bsk_live_[0-9A-Za-z]{20,}|\bAIza[0-9A-Za-z_-]{35}|\bglpat-[0-9A-Za-z_-]{20,})
  | (?P<comment>/\*(?:[^*]|\*(?!/))*\*/)
  | (?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)
  | (?P<tag><(?P<tagname>[A-Za-z_][\w.-]*)>(?P<tagged>[^<>\n]*)</(?P=tagname)>)
  | (?P<name>(?:(?<=[^\w])|^|(?<=[\w]{0}))[^\W\d][\w]*(?:[.-][^\W\d][\w]*)*)
  | (?P<assign>:=|=>|={1,3}|:(?!:|//))
  | (?P<join>\+|\.(?=\s*["'`]))
  | (?P<end>[\n;,{}()\[\]])
  | (?P<bare>[^\s"'`;,{}()\[\]=:+<>]+)
    """,
    re.X,
)


def name_parts(name: str) -> list[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return [p.lower() for p in re.split(r"[^A-Za-z0-9]+|\s+", spaced) if p]


def sensitivity(name: str) -> float:
    """The highest weight among a name's parts and neighbouring parts joined."""
    parts = name_parts(name)
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    most = max((SENSITIVE.get(p, 0.0) for p in parts + pairs), default=0.0)
    return most - 2.5 * (bool(parts) and parts[-1] in HARMLESS or bool(set(parts) & {"public"}))


def randomness(value: str) -> float:
    """Up to 4 points for a literal that no one would write by hand."""
    if PLACEHOLDER.match(value) or len(value) < 6 or LOOKUP.search(value):
        return -4.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    points = min(2.0, max(0.0, entropy - 1.5)) + min(1.0, n / 24)
    kinds = bool(re.search(r"\d", value)) + bool(re.search(r"[a-z]", value)) + bool(re.search(r"[A-Z]", value)) + bool(re.search(r"[^\w\s]", value))
    points += 0.35 * (kinds - 1) + 0.5 * bool(re.fullmatch(r"[0-9a-fA-F]{16,}|[A-Za-z0-9+/_=-]{20,}", value) and re.search(r"\d", value))
    if re.search(r"\s", value.strip()):
        points -= 1.5 + 0.5 * value.count(" ")
    if re.match(r"[a-z][a-z0-9+.-]*://", value) and not re.search(r"://[^/\s:@]+:[^/\s@]+@", value):
        points -= 2.0
    return points


def findings(text: str) -> list[tuple[int, int, str, float]]:
    """start, end, name, score of each secret literal, in order."""
    Where = dict[tuple[int, int], str]
    known: dict[str, Where] = {}  # constants: the literals that a name stands for, each once
    best: dict[tuple[int, int], tuple[float, str]] = {}
    grown: set[str] = set()  # names that were added to: judged when the text ends

    def reach(name: str, where: Where) -> None:
        worth = sensitivity(name)
        if worth <= 0:
            return
        score = worth + randomness("".join(where.values()))
        for at in where:
            if score >= LEAST and at[0] < at[1] and score > best.get(at, (0.0, ""))[0]:
                best[at] = score, name

    target, operands, ready, left = None, {}, False, None  # left: the last name or literal, which may prove a target

    def close() -> None:
        nonlocal target, operands, ready
        if target is not None and operands:
            if known.get(target) is operands:
                grown.add(target)
            else:
                if target in grown:
                    grown.discard(target)
                    reach(target, known[target])
                known[target] = operands
                reach(target, operands)
        target, operands, ready = None, {}, False

    for m in LEX.finditer(text):
        kind = m.lastgroup
        if kind == "tagged" or m["tag"] is not None:
            close()
            a, z = m.span("tagged")
            known[m["tagname"]] = {(a, z): text[a:z]}
            reach(m["tagname"], known[m["tagname"]])
            left = None
        elif kind == "shape":
            best[m.span()] = max(best.get(m.span(), (0.0, "")), (9.0, target or ""))
            if ready:
                operands[m.span()], ready = m.group(), False
            left = None
        elif kind == "text":
            a, z = m.start() + 1, m.end() - 1
            if ready:
                operands[a, z], ready = text[a:z], False
            elif target is not None:
                close()
            left = text[a:z]
        elif kind == "name":
            if ready:
                word = m.group()
                if word in known:
                    operands, ready = known[word] if word == target and not operands else operands | known[word], False
                elif LINE_END.match(text, m.end()) or randomness(word) >= 2.5:  # an unquoted value
                    operands[m.span()], ready = word, False
                else:
                    close()
            elif target is not None:
                close()
            left = m.group()
        elif kind == "assign":
            if left is not None:
                close()
                target, operands, ready = left, {}, True
            left = None
        elif kind == "join":
            ready = target is not None and bool(operands)
            left = None
        elif kind == "bare":
            if ready:
                operands[m.span()], ready = m.group(), False
            elif target is not None and operands and (at := next(reversed(operands)))[1] == m.start():  # the value goes on
                operands[at[0], m.end()] = operands.pop(at) + m.group()
            left = None
        elif kind == "end":
            if m.group() == "\n" and ready and not operands or m.group() == "(" and ready:
                ready = False
            close()
            left = None
    close()
    for name in sorted(grown):
        reach(name, known[name])
    return [(a, z, name, round(score, 3)) for (a, z), (score, name) in sorted(best.items())]


def merged(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z, _, _ in found:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, name, first_char, end_char, score, digest of each finding; the
    literal itself isn't carried on, but the first 16 digits of its SHA-256."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, out = [], []
            hold = pc.fill_null(pc.match_substring_regex(b.column(1), MAY_HOLD), False).to_numpy(zero_copy_only=False).nonzero()[0]
            for i in hold.tolist():
                t = b.column(1)[i].as_py()
                for a, z, name, score in findings(t):
                    at.append(i)
                    out.append((name, a, z, score, sha256(t[a:z].encode("utf-8", "surrogatepass")).hexdigest()[:16]))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, t) for x, t in zip(cols, kinds))], names=["doc_id", "name", "first_char", "end_char", "score", "digest"])

    return rows.mapInArrow(run, f"doc_id {kind}, name string, first_char long, end_char long, score double, digest string")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]", count_col: str = "n_chars") -> DataFrame:
    """docs, all rows and columns, with `mark` for each secret; count_col, if it
    is a column of whole numbers, follows the length of a text that changes."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    counted = docs.columns.index(count_col) if count_col in docs.columns and isinstance(docs.schema[count_col].dataType, (T.LongType, T.IntegerType)) else None

    def run(batches):
        for b in batches:
            hold = pc.fill_null(pc.match_substring_regex(b.column(at), MAY_HOLD), False).to_numpy(zero_copy_only=False).nonzero()[0]
            changed: dict[int, str] = {}
            for i in hold.tolist():
                t = b.column(at)[i].as_py()
                if spans := merged(findings(t)):
                    ends = [0, *(z for _, z in spans)]
                    changed[i] = mark.join([t[e:a] for e, (a, _) in zip(ends, spans)] + [t[ends[-1] :]])
            yield edited(b, changed, at, counted)

    return docs.mapInArrow(run, docs.schema)


def edited(b: pa.RecordBatch, changed: dict[int, str], at: int, counted: int | None) -> pa.RecordBatch:
    """b with the texts of some rows changed."""
    if not changed:
        return b
    columns, mask = list(b.columns), pa.array([i in changed for i in range(b.num_rows)])
    order = sorted(changed)
    columns[at] = pc.replace_with_mask(columns[at], mask, pa.array([changed[i] for i in order], columns[at].type))
    if counted is not None:
        columns[counted] = pc.replace_with_mask(columns[counted], mask, pa.array([len(changed[i]) for i in order], columns[counted].type))
    return pa.RecordBatch.from_arrays(columns, schema=b.schema)
