"""Parsers of filings: the text of an electronic report, and the tables of an HTML report; batches of documents pass through Python in Arrow form."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("owner", "asset", "ticker", "kind", "operation", "transaction_date", "notification_date", "amount")
# ---- fixed values: what stands in the reports
#: The line that ends a transaction: letter, two dates and an amount, whose upper bound may follow on a later line.
_END = re.compile(
    r"^(?P<head>.*?)\s*\b(?P<op>P|S|E)(?:\s*\((?P<part>partial|full)\))?\s+(?P<on>\d{1,2}/\d{1,2}/\d{4})\s+(?P<told>\d{1,2}/\d{1,2}/\d{4})\s+"
    r"(?P<low>(?:Over )?\$[\d,]+\+?)\s*(?P<dash>-?)\s*(?P<high>\$[\d,]+)?\s*$",
    re.I,
)
_OWNER, _KIND, _HIGH = re.compile(r"^(SP|DC|JT)\s+", re.I), re.compile(r"\[([A-Za-z]{2})\]"), re.compile(r"\$[\d,]+")
_SYMBOL, _DASHED = re.compile(r"\(([A-Za-z][A-Za-z0-9.\-]{0,6})\)"), re.compile(r"^-\s*([A-Z]{2,5})$")
EXCHANGES = ("NYSE", "NASDAQ", "NYSEARCA", "BATS", "AMEX", "CBOE")
#: Lines of the page around the transactions, by how they start, whatever their case.
FURNITURE = (
    "filing id", "id owner", "transaction", "type", "date", "notification", "amount", "cap.", "gains", "$200", "name:", "status:", "state/district:", "clerk of", "digitally", "i certify", "certification",
    "initial public", "for the complete", "filing status", "subholding", "description:", "location:", "asset class", "yes no", "f s:", "s o:", "s s:", "f o:", "l:", "d:", "c:", "g:", "* for",
)
#: Words that tell a note on a trade from the name of its asset.
NOTES = re.compile(r"\bshares\b|/share|@\s*\$|\bsold @", re.I)
HEADERS = {"transaction_date": ("transaction date", "date"), "owner": ("owner",), "ticker": ("ticker", "symbol"), "asset": ("asset name", "asset"), "kind": ("asset type",), "operation": ("transaction type", "type", "transaction"), "amount": ("amount",)}
LOOK_BACK, LOOK_AHEAD = 4, 5
# ----
_EXCHANGE = re.compile(r"\b(?:" + "|".join(EXCHANGES) + r")[:\s]+([A-Za-z]{1,5})\b", re.I)
_LISTED = re.compile(r"\(\s*(?:" + "|".join(EXCHANGES) + r")[:\s]+[A-Za-z]{1,5}\s*\)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")


def squeezed(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


def _around(line: str) -> bool:
    """Whether a line belongs to the page or is a note, so that no asset's name goes on through it."""
    s = line.lower()
    return s.startswith(FURNITURE) or bool(NOTES.search(line))


def parse_report(text: str | None) -> list[dict]:
    """The transactions of a report's text.

    A transaction ends on the line with its letter, two dates and amount. Its asset is what precedes on that line and on up to four lines before that
    belong to no other, to the page or to a note. The upper bound of a broken amount, the rest of the name, the symbol (in parentheses, after a dash or after an
    exchange) and the kind may follow on up to five lines, as long as something of these is missing.
    """
    out, used = [], -1
    lines = [x.strip() for x in (text or "").replace("\x00", "").split("\n")]
    ends = [_END.match(x) for x in lines]
    for i, m in enumerate(ends):
        if not m:
            continue
        before = []
        for j in range(i - 1, max(used, -1), -1):
            if len(before) == LOOK_BACK or ends[j] or not lines[j] or _around(lines[j]):
                break
            before.insert(0, lines[j])
        parts, used, high = [*before, m["head"]], i, m["high"]
        for j in range(i + 1, min(len(lines), i + 1 + LOOK_AHEAD)):
            line = lines[j]
            if not line or ends[j] or _around(line):
                break
            bound = _HIGH.search(line) if m["dash"] and not high else None
            if bound:
                high = bound[0]
                line = squeezed(line[: bound.start()] + " " + line[bound.end() :])
            done = any(_KIND.search(p) for p in parts)
            if line and not done:
                code = _KIND.search(line)
                name = line[: code.start()].strip() if code else line
                dashed = _DASHED.match(name)
                parts.append(f"({dashed[1]}) {line[code.start() :] if code else ''}" if dashed else line)
            elif not bound:
                break
            used = j
        body = squeezed(" ".join(parts))
        if owner := _OWNER.match(body):
            body = body[owner.end() :]
        symbols = [s for s in _SYMBOL.findall(body) if s.lower() not in ("partial", "full")] or _EXCHANGE.findall(body)
        kind = _KIND.search(body)
        op = {"P": "Purchase", "E": "Exchange"}.get(m["op"].upper(), f"Sale ({m['part'].capitalize()})" if m["part"] else "Sale")
        name = squeezed(_LISTED.sub("", _KIND.sub("", _SYMBOL.sub("", body)))).strip(" -")
        amount = m["low"] if not high else f"{m['low']} - {high}"
        out.append(dict(zip(FIELDS, (owner[1].upper() if owner else None, name, symbols[0].upper() if symbols else None, kind[1].upper() if kind else None, op, m["on"], m["told"], amount))))
    return out


def plain_operation(text: str | None) -> str | None:
    """Purchase, Exchange, Sale (Partial), Sale (Full) or Sale, the first that a wording fits; else the wording itself."""
    s = (text or "").strip().lower()
    for fits, name in ((s.startswith("p"), "Purchase"), ("exchange" in s, "Exchange"), ("partial" in s, "Sale (Partial)"), ("full" in s, "Sale (Full)"), (s.startswith("s"), "Sale")):
        if fits:
            return name
    return text


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables: list[int] = []
        self.rows, self.cell, self.number = [], None, 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.number += 1
        elif tag == "tr":
            self.rows.append([])
            self.tables.append(self.number)
        elif tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(squeezed("".join(self.cell)))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def parse_tables(html: str | None) -> list[dict]:
    """The transactions of an HTML report: those of the first table with a row whose cells head a date and an asset, or a symbol; that row tells the columns, whatever
    their order. Operations are given in plain words, blanks are squeezed, and cells of -- or nothing are null."""
    p = _Tables()
    p.feed(html or "")
    places, out, at_table = None, [], 0
    for row, number in zip(p.rows, p.tables):
        if places is not None and number != at_table:
            break
        heads = [c.lower() for c in row]
        if places is None:
            found: dict[str, int] = {}
            for field, names in HEADERS.items():
                for n in names:
                    at = next((i for i, h in enumerate(heads) if h == n or (h.startswith(n) and i not in found.values())), None)
                    if at is not None and at not in found.values():
                        found[field] = at
                        break
            if "transaction_date" in found and found.keys() & {"asset", "ticker"}:
                places, at_table = found, number
            continue
        get = lambda f: row[places[f]] or None if f in places and places[f] < len(row) else None
        if len(row) > 1:
            row_of = {f: (None if (v := get(f)) in ("--", "nan", "None", None) else v) for f in FIELDS}
            out.append(row_of | {"operation": plain_operation(row_of["operation"])})
    return out


def parsed(documents: DataFrame, doc_id: str, text: str, parser: Callable[[str | None], list[dict]]) -> DataFrame:
    """(doc_id, pos, fields): a row for each transaction that the parser finds; documents without one, and null texts, give none."""
    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, pos int, " + ", ".join(f"{f} string" for f in FIELDS)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, pos, rows = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, r in enumerate(parser(t)):
                    at.append(i)
                    pos.append(k)
                    rows.append(r)
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), *[pa.array([r[f] for r in rows], pa.string()) for f in FIELDS]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "pos", *FIELDS])

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, schema)
