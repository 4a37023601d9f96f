"""Personal data by weak supervision (operator 8).

Base spans come from four fixed patterns and are always kept.  Further
candidates are put to labelers that vote for (+1), against (-1) or abstain (0):
the form's own check, gazetteers (issuer and country prefixes, top-level domains,
reserved networks, first names), words before and after, grouping, repeated
digits and glued characters.  Further forms are: addresses spelled out (``bob [at]
host [dot] com``), national phone numbers of several groupings and numbers after
``00``, IPv6 and defanged addresses (``10[.]1[.]2[.]3``), cards grouped by other
signs, and whatever misses a base rule (octets over 255, no Luhn).

1. Every document's candidates are written once, each with its votes and with
   features of the span and its context (``describe``) that are no votes.
2. They are counted over all documents by (kind, votes, features): a table whose
   size depends on labelers and features alone.
3. Expectation-maximisation on the votes' counts estimates each labeler's
   reliability per class and the share of true spans, without labels.
4. A logistic span classifier learns the posteriors from the features, and a
   candidate beside the base is added when the mean of the classifier's
   probability and the posterior of its votes is at least ``LIMIT``.

Edge cases: null or empty text has no spans; null and repeated doc_ids are kept
row by row; an added span never overlaps a base span or another of its kind;
without candidates no model is fitted and base spans alone are returned; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .storage import materialize
from .text_batches import slices, texts

KINDS = ("email", "ip", "card", "phone")
LIMIT = 0.9
NEAR = 30

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Further forms.  Each begins where no sign of its own kind stands before it and
#: has bounded parts, so looking for them is linear in the text.
FURTHER_PHONE = re.compile(
    r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3,5}\)[ ]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|0[1-9](?:[ .-][0-9]{2}){4}|0[0-9]{2,4}[ /-][0-9]{3,4}[ -]?[0-9]{2,4}(?:[ -][0-9]{2,4})?|00[1-9][0-9]{0,2}(?:[ -]?[0-9]{2,4}){3,4})(?![0-9A-Za-z])"
)
SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[ ]?(?:[\[({<][ ]?(?:at|AT|@)[ ]?[\])}>]|[ ](?:at|AT)[ ])[ ]?[A-Za-z0-9-]{1,63}(?:(?:[ ]?[\[({<][ ]?(?:dot|DOT|punkt|punto|point|\.)[ ]?[\])}>][ ]?|[ ](?:dot|DOT)[ ]|\.)[A-Za-z0-9-]{1,63}){1,4}(?![A-Za-z0-9@-])"
)
FURTHER_IP = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}(?:\[\.\]|\(\.\)|[ ]?\[dot\][ ]?)[0-9]{1,3}(?:(?:\[?\.\]?|\(\.\)|[ ]?\[dot\][ ]?)[0-9]{1,3}){2}|(?:[0-9A-Fa-f]{1,4}:){2,7}(?:[0-9A-Fa-f]{1,4}|:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}))(?![0-9A-Za-z:])")
FURTHER_CARD = re.compile(r"(?<![0-9A-Za-z.])[0-9]{4}([.\u00a0/_]|[ ]{2}|[ ]-[ ])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9A-Za-z])")

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Gazetteers (fixed values).
TOP_LEVEL = frozenset("com net org edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn in br ru ch se no".split())
RESERVED = ("0.", "10.", "127.", "192.168.", "169.254.", "255.")
ISSUERS = re.compile(r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)")
COUNTRIES = re.compile(r"^(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
FIRST_NAMES = frozenset("james john robert michael william david richard thomas mary patricia jennifer linda elizabeth susan anna maria peter paul hans klaus jean pierre luis carlos jose juan bob alice tom ann eva jan max lisa sarah laura julia".split())
CALLS = {
    "email": re.compile(r"(?i)mail|contact|write|reach|send|ask|ping"),
    "ip": re.compile(r"(?i)\bip\b|addr|host|server|login|from|client"),
    "card": re.compile(r"(?i)card|visa|master|amex|pay|credit|debit|billing|account"),
    "phone": re.compile(r"(?i)phone|call|tel|mobile|fax|dial|contact|sms|whatsapp"),
}
THANKS = re.compile(r"(?i)^\W{0,3}\s?(?:is (?:my|his|her|our|the)|thanks|anytime|any ?time|today|tonight|tomorrow|or (?:write|call|mail)|if you|for (?:details|help|more)|between|before|after)\b")
DENIES = re.compile(r"(?i)version|\bv$|release|isbn|issn|order|invoice|serial|section|figure|page|build|rfc|part no|€|\$|%")
LABELERS = ("check", "gazetteer", "calls", "thanks", "denies", "grouping", "uniform", "glued")
#: Positions of a feature string (``describe``).
FEATURES = ("form", "digits", "length", "separators", "before", "after", "call_near", "deny_near", "line", "company")


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def emails(text: str):
    """Leftmost matches of the address pattern: every match ends its local part
    at an @, and begins with the run of local characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        if begin < at and (found := DOMAIN.match(text, at)):
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) of base spans and of further candidates, by start."""
    found, missed = [], []
    if "@" in text:
        found += [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        (found if octets(m[0]) else missed).append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19:
            (found if luhn(digits) else missed).append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    for kind, form in ((0, SPELLED), (1, FURTHER_IP), (2, FURTHER_CARD), (3, FURTHER_PHONE)):
        if kind or SPELLED_SIGN.search(text):
            missed += [(kind, m.start(), m.end()) for m in form.finditer(text)]
    held = {kind: [] for kind in (*range(len(KINDS)), None)}  # disjoint spans, ascending
    for a, b in sorted((a, b) for _, a, b in found):
        _hold(held[None], a, b)
    out = [(a, k, b, True) for k, a, b in found]
    for k, a, b in sorted(missed, key=lambda x: (x[1], -x[2])):
        if not _meets(held[None], a, b) and not _meets(held[k], a, b):
            held[k].append((a, b))
            out.append((a, k, b, False))
    return sorted(out)


def _hold(spans: list[tuple[int, int]], a: int, b: int) -> None:
    if spans and a < spans[-1][1]:
        spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
    else:
        spans.append((a, b))


def _meets(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether [a, b) overlaps one of the disjoint ascending spans."""
    at = bisect_left(spans, (b,))
    return at > 0 and spans[at - 1][1] > a


def spelled_out(span: str) -> str:
    """An address with its signs instead of the words for them."""
    span = re.sub(r"\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s(?:at|AT)\s", "@", span, count=1)
    return re.sub(r"\s?[\[({<]\s?(?:dot|DOT|punkt|punto|point|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s", ".", span)


def _address(span: str) -> bool:
    try:
        ipaddress.ip_address(re.sub(r"\s?[\[(](?:dot|\.)[\])]\s?", ".", span))
    except ValueError:
        return False
    return True


def votes(text: str, kind: int, start: int, end: int) -> list[int]:
    """One vote per labeler."""
    span, name = text[start:end], KINDS[kind]
    digits = digits_of(span)
    before, after = text[max(0, start - NEAR) : start], text[end : end + 1]
    if kind == 0:
        whole = spelled_out(span)
        local, _, domain = whole.partition("@")
        known = domain.rpartition(".")[2].lower() in TOP_LEVEL
        check = 1 if "@" in span or re.search(r"[\[({<]", span) else 0
        gazetteer = (1 if known or not FIRST_NAMES.isdisjoint(re.split(r"[._+-]", local.lower())) else 0) if known or "@" in span else -1
        grouping = -1 if ".." in whole or whole[0] in ".-" or local.lower() in STOP_WORDS else 1
    elif kind == 1:
        check, gazetteer = (1 if _address(span) else -1), (-1 if span.startswith(RESERVED) else 1)
        grouping = -1 if "." in span and any(len(p) > 1 and p[0] == "0" for p in re.split(r"\D+", span)) else 1
        if ":" in span and "::" not in span and span.count(":") < 7:
            check = -1  # times and ratios
    elif kind == 2:
        check, gazetteer = (1 if luhn(digits) else -1), (1 if ISSUERS.match(digits) else -1)
        grouping = 1 if re.fullmatch(r"[0-9]{4}(\D{0,3}[0-9]{4}){2}\D{0,3}[0-9]{1,7}|[0-9]{12,19}", span) else -1
    else:
        check = 1 if span[0] == "+" or span.startswith("00") else 0
        gazetteer = (1 if COUNTRIES.match(digits.removeprefix("00")) else -1) if check else 0
        grouping = 1 if re.search(r"[ .()/-]", span) else 0
    glued = (before[-1:].isalnum() or before[-1:] in ("_", "/", "#")) or (after.isalnum() or after == "_")
    calls, thanks = CALLS[name].search(before), THANKS.search(text[end : end + NEAR])
    return [check, gazetteer, 1 if calls else 0, 1 if thanks else 0, -1 if DENIES.search(before) or after == "%" else 0, grouping, -1 if digits and len(set(digits)) < 3 else 0, -1 if glued else 0]


def describe(text: str, kind: int, start: int, end: int, base: bool, company: int) -> str:
    """Features of a span and its context, one sign each (``FEATURES``)."""
    span = text[start:end]
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    signs = {c for c in span if not c.isalnum()}
    side = lambda c: "^" if not c else "a" if c.isalpha() else "0" if c.isdigit() else "_" if c.isspace() else c if c in ":.,;()<>[]\"'/=#%-" else "?"
    form = "b" if base else "x" if kind == 0 or re.search(r"[\[({<:]", span) else "m" if (kind == 1 or kind == 2 and CARD.fullmatch(span)) else "f"
    calls, denies = list(CALLS[KINDS[kind]].finditer(before)), list(DENIES.finditer(before))
    near = lambda found: "0" if not found else "1" if found[-1].end() > len(before) - 12 else "2"
    line = "1" if not before.rpartition("\n")[2].strip() else "0"
    return form + f"{min(len(digits_of(span)), 20):c}".translate(_LETTERS) + f"{min(len(span) // 4, 20):c}".translate(_LETTERS) + str(min(len(signs), 4)) + side(before[-1:]) + side(after[:1]) + near(calls) + near(denies) + line + str(min(company, 3))


_LETTERS = {k: chr(97 + k) for k in range(21)}
SPELLED_SIGN = re.compile(r"[\[({<][ ]?(?:at|AT|@)[ ]?[\])}>]|[ ](?:dot|DOT)[ ]")
STOP_WORDS = frozenset("a an and are as be been is it look looked looking meet met of or stay sit that the them this to up was we were you".split())


SPAN = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:string,seen:string>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("seen", pa.string())]))


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, spans: candidates with their votes as a string of -, 0 and +, and
    their features (``seen``)."""

    def run(batches):
        for whole in batches:
            for some in slices(whole):
                column = texts(some)
                worth = pc.match_substring_regex(column, WORTH).to_numpy(zero_copy_only=False)
                rows = []
                for i, look in enumerate(worth.tolist()):
                    text = column[i].as_py() if look else ""
                    found = candidates(text)
                    sure = sum(kept for *_, kept in found)
                    rows.append([
                        {"kind": k, "start": a, "end": b, "base": kept, "votes": "".join("-0+"[v + 1] for v in votes(text, k, a, b)), "seen": describe(text, k, a, b, kept, sure - kept)}
                        for a, k, b, kept in found
                    ])
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(rows, SPAN_TYPE)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans {SPAN}")


#: What a text must hold to have any candidate.
WORTH = r"[0-9@]|[\[({<] ?(at|AT) ?[\])}>]| (dot|DOT) |::"


def one_hot(patterns: list[tuple[int, str]]) -> np.ndarray:
    """Rows of (kind, labeler's outcome) indicators."""
    out = np.zeros((len(patterns), len(KINDS) + 3 * len(LABELERS)))
    for row, (kind, votes_) in enumerate(patterns):
        out[row, kind] = 1
        for j, v in enumerate(votes_):
            out[row, len(KINDS) + 3 * j + "-0+".index(v)] = 1
    return out


def estimate(patterns: list[tuple[int, str]], counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of each pattern by expectation-maximisation with one table of
    outcomes per labeler and class; it starts from the majority of the votes."""
    outcome = one_hot(patterns)[:, len(KINDS) :]
    margin = np.array([v.count("+") - 1.5 * v.count("-") for _, v in patterns], float)
    posterior = 1 / (1 + np.exp(-1.5 * margin))
    kind = np.array([k for k, _ in patterns])
    for _ in range(rounds):
        score = np.zeros((len(patterns), 2))
        for c, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            table = (weight @ outcome).reshape(-1, 3) + 0.5
            score[:, c] = outcome @ np.log(table / table.sum(axis=1, keepdims=True)).ravel()
            shares = np.bincount(kind, weight, len(KINDS)) + 1
            score[:, c] += np.log(shares)[kind]
        posterior = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
    return posterior


class SpanClassifier:
    """Logistic regression on indicators of (kind, form), (kind, digits) and the
    other features, fitted to posteriors weighted by counts."""

    def __init__(self, seen: list[tuple[int, str]], counts: np.ndarray, posterior: np.ndarray, rounds: int = 60):
        self.names = {n: i for i, n in enumerate(sorted({n for s in seen for n in self._names(*s)}))}
        x, self.weights = self._rows(seen), np.zeros(len(self.names))
        share = counts / counts.sum()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-x @ self.weights))
            curve = x.T @ (x * (share * p * (1 - p))[:, None]) + 1e-3 * np.eye(x.shape[1])
            step = np.linalg.solve(curve, x.T @ (share * (posterior - p)) - 1e-3 * self.weights)
            self.weights = self.weights + np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-8:
                break

    @staticmethod
    def _names(kind: int, seen: str) -> list[str]:
        return [f"{kind}", *(f"{kind if j < 3 else ''}/{name}/{sign}" for j, (name, sign) in enumerate(zip(FEATURES, seen, strict=True)))]

    def _rows(self, seen: list[tuple[int, str]]) -> np.ndarray:
        out = np.zeros((len(seen), len(self.names)))
        for row, s in enumerate(seen):
            out[row, [self.names[n] for n in self._names(*s) if n in self.names]] = 1
        return out

    def probability(self, seen: list[tuple[int, str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-self._rows(seen) @ self.weights))


def score_patterns(rows: list[tuple[int, str, str, int]]) -> dict[tuple[int, str, str], float]:
    """Probability of each (kind, votes, features) from their counts."""
    if not rows:
        return {}
    counts = np.array([n for *_, n in rows], float)
    votes_of: dict[tuple[int, str], float] = {}
    for (k, v, _, _), n in zip(rows, counts.tolist(), strict=True):
        votes_of[k, v] = votes_of.get((k, v), 0.0) + n
    posterior = dict(zip(votes_of, estimate(list(votes_of), np.array(list(votes_of.values()))).tolist(), strict=True))
    target = np.array([posterior[k, v] for k, v, *_ in rows])
    seen = [(k, s) for k, _, s, _ in rows]
    both = (SpanClassifier(seen, counts, target).probability(seen) + target) / 2
    return dict(zip([r[:3] for r in rows], both.tolist(), strict=True))


def find_personal_data(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id, spans (kind, start, end, base, score), by start, then kind."""
    found = materialize(find_candidates(docs), "candidates")
    counted = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.seen").count()
    score = score_patterns(sorted((r["kind"], r["votes"], r["seen"], r["count"]) for r in counted.collect()))  # bounded by the number of patterns
    kind_type = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            out = []
            for spans in batch.column("spans").to_pylist():
                judged = [{"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"], "base": s["base"], "score": score[s["kind"], s["votes"], s["seen"]]} for s in spans]
                out.append([s for s in judged if s["base"] or s["score"] >= limit])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, arrow)], ["doc_id", "spans"])

    return found.mapInArrow(run, f"doc_id long, spans {kind_type}")


def personal_data_digests(docs: DataFrame) -> DataFrame:
    """doc_id, base spans counted by kind and digested, all spans and their number."""
    found = find_personal_data(docs)
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base AND s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
