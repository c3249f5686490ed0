"""Operator 1: personal data replaced by format-preserving Feistel pseudonyms.

Found values are validated (Luhn and IBAN check digits, calendar dates, octets,
number plans), mapped to their number within all values of the same format,
keyed-permuted there, and written back in the same format: same length,
separators, character classes and valid check digits.  Equal values get equal
pseudonyms in every document, no value keeps its own, and ``restore`` with the
key gives the texts back.

Formats: e-mail addresses (letters and digits of the local part), phone
numbers, payment cards, IBANs, social security numbers, IPv4 addresses,
calendar dates, hardware addresses, and secrets (access keys, long hex tokens,
``password=`` values).

Each text is independent, so this is one narrow step without a shuffle.
"""

from __future__ import annotations

import datetime
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobi.llm.feistel import Permutation

#: for tests and queries; give your own key to ``pseudonymise``
KEY = b"pseudonym key of the registered query"

#: a text without one of these holds no value
_MAY_HOLD = re.compile(r"[0-9@]|=")

# groups with names of two letters are separators
_FINDER = re.compile("|".join([
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)",
    r"(?P<secret>(?i:password|passwd|pwd|secret|api_?key)=[^\s\"'&;,]*[^\s\"'&;,.!?:)])",
    r"(?P<access>(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9]))",
    r"(?P<hex>(?<![A-Za-z0-9])[0-9a-f]{32,128}(?![A-Za-z0-9]))",
    r"(?P<mac>(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Za-z:]))",
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
    r"(?P<ymd>(?<![0-9./-])[0-9]{4}([-/.])[0-9]{1,2}\g<SEP1>[0-9]{1,2}(?![0-9]|[./-][0-9]))",
    r"(?P<dmy>(?<![0-9./-])[0-9]{1,2}([-/.])[0-9]{1,2}\g<SEP2>[0-9]{4}(?![0-9]|[./-][0-9]))",
    r"(?P<ipv4>(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9]))",
    r"(?P<ssn>(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9]))",
    r"(?P<card>(?<![0-9A-Za-z.+-])(?:[0-9]{13,19}|[0-9]{4}(?P<c1>[ -])[0-9]{4}(?P=c1)[0-9]{4}(?P=c1)[0-9]{1,7}"
    r"|[0-9]{4}(?P<c2>[ -])[0-9]{6}(?P=c2)[0-9]{5})(?![0-9A-Za-z]|-[0-9]))",
    r"(?P<phone>(?<![0-9A-Za-z+.])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+.])\+(?!1[ (.-])[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,5}){1,5}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z(.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z]|-[0-9]))",
]).replace(r"([-/.])[0-9]{1,2}\g<SEP1>", r"(?P<s1>[-/.])[0-9]{1,2}(?P=s1)")
  .replace(r"([-/.])[0-9]{1,2}\g<SEP2>", r"(?P<s2>[-/.])[0-9]{1,2}(?P=s2)"))

_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_LAST_DAY = datetime.date(2099, 12, 31).toordinal()
_CLASSES = {**{c: ("0", 10) for c in "0123456789"}, **{chr(97 + k): ("a", 26) for k in range(26)},
            **{chr(65 + k): ("A", 26) for k in range(26)}}


def _luhn(digits: str) -> int:
    """Check digit that follows ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


@lru_cache(maxsize=16)
def _days(kind: str, day_width: int, month_width: int) -> tuple[list[int], dict[int, int]]:
    """Days of a written form: one-digit fields hold 1 to 9; a month-first
    date is told from a day-first one by a day above 12."""
    out = []
    for n in range(_FIRST_DAY, _LAST_DAY + 1):
        d = datetime.date.fromordinal(n)
        if (day_width == 2 or d.day < 10) and (month_width == 2 or d.month < 10) and (kind != "mdy" or d.day > 12):
            out.append(n)
    return out, {n: k for k, n in enumerate(out)}


class Pseudonyms:
    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self._permutation = lru_cache(maxsize=4096)(lambda n, tweak: Permutation(n, key, tweak))
        self.value = lru_cache(maxsize=65536)(self._value)

    def _move(self, x: int, n: int, tweak: str) -> int:
        return self._permutation(n, tweak).other(x, self.back)

    def _digits(self, text: str, tweak: str) -> str:
        return str(self._move(int(text), 10 ** len(text), tweak)).zfill(len(text))

    def _classes(self, text: str, tweak: str, classes=_CLASSES) -> str:
        """Every character of a class is replaced within its class."""
        x, n = 0, 1
        for c in text:
            if c in classes:
                low, size = classes[c]
                x, n = x * size + (ord(c) - ord(low)), n * size
        x = self._move(x, n, tweak + "".join(classes[c][0] if c in classes else c for c in text))
        out = []
        for c in reversed(text):
            if c in classes:
                low, size = classes[c]
                x, r = divmod(x, size)
                c = chr(ord(low) + r)
            out.append(c)
        return "".join(reversed(out))

    def _hex(self, text: str, tweak: str) -> str:
        return format(self._move(int(text, 16), 16 ** len(text), tweak), f"0{len(text)}x")

    def _value(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None if the value is not valid."""
        return getattr(self, "_" + kind + "_value")(text)

    def _email_value(self, text: str) -> str | None:
        local, _, host = text.partition("@")
        if not any(c in _CLASSES for c in local):
            return None
        return f"{self._classes(local, 'email')}@{host}"

    def _secret_value(self, text: str) -> str | None:
        name, _, value = text.partition("=")
        return f"{name}={self._classes(value, 'secret')}"

    def _access_value(self, text: str) -> str:
        return text[:4] + self._classes(text[4:], "access")

    def _hex_value(self, text: str) -> str | None:
        return None if text.isdigit() else self._keep_letter(text)

    def _keep_letter(self, text: str) -> str:
        """Cycle-walking inside the hex tokens that hold a letter."""
        new = self._hex(text, "hex")
        while new.isdigit():
            new = self._hex(new, "hex")
        return new

    def _mac_value(self, text: str) -> str:
        new = self._hex(text.replace(":", "").lower(), "mac")
        new = ":".join(new[k:k + 2] for k in range(0, 12, 2))
        return new.upper() if text == text.upper() else new

    def _iban_value(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
            return None
        body = self._classes(plain[4:], "iban" + plain[:2])
        new = plain[:2] + f"{98 - _iban_rest(plain[:2] + '00' + body):02d}" + body
        chars = iter(new)
        return "".join(c if c == " " else next(chars) for c in text)

    def _date(self, kind: str, fields: list[str], year: int, month: int, day: int) -> str | None:
        y, m, d = (int(fields[k]) for k in (year, month, day))
        try:
            n = datetime.date(y, m, d).toordinal()
        except ValueError:
            return None
        days, place = _days(kind, len(fields[day]), len(fields[month]))
        if n not in place:
            return None
        new = datetime.date.fromordinal(days[self._move(place[n], len(days), f"day{kind}{len(days)}")])
        out = list(fields)
        out[year] = f"{new.year:04d}"
        out[month], out[day] = str(new.month).zfill(len(fields[month])), str(new.day).zfill(len(fields[day]))
        return out

    def _ymd_value(self, text: str) -> str | None:
        out = self._date("day", re.split(r"[-/.]", text), 0, 1, 2)
        return out and text[4].join(out)

    def _dmy_value(self, text: str) -> str | None:
        fields = re.split(r"[-/.]", text)
        month_first = int(fields[1]) > 12
        out = self._date("mdy", fields, 2, 0, 1) if month_first else self._date("day", fields, 2, 1, 0)
        return out and text[-5].join(out)

    def _ipv4_value(self, text: str) -> str | None:
        octets = text.split(".")
        if any(int(o) > 255 or str(int(o)) != o for o in octets):
            return None
        x = self._move(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _ssn_value(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x = self._move(x, 898 * 99 * 9999, "ssn")
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        area += 1 + (area + 1 >= 666)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _refill(self, text: str, digits: str) -> str:
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in text)

    def _card_value(self, text: str) -> str | None:
        digits = re.sub(r"[ -]", "", text)
        if _luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        while True:
            body = digits[0] + self._digits(digits[1:-1], "card" + digits[0])
            digits = body + str(_luhn(body))
            if len(set(digits)) > 1:
                return self._refill(text, digits)

    def _phone_value(self, text: str) -> str | None:
        digits = re.sub(r"[^0-9]", "", text)
        plus = text.startswith("+")
        if not plus or digits.startswith("1") and len(digits) == 11:
            head, body = digits[:-10], digits[-10:]
            if body[0] in "01" or body[3] in "01":
                return None
            x = ((int(body[:3]) - 200) * 800 + int(body[3:6]) - 200) * 10000 + int(body[6:])
            x = self._move(x, 800 * 800 * 10000, "phone")
            x, line = divmod(x, 10000)
            area, exchange = divmod(x, 800)
            return self._refill(text, f"{head}{area + 200}{exchange + 200}{line:04d}")
        if not 8 <= len(digits) <= 15:
            return None
        country = len(re.match(r"\+([0-9]{1,3}?)(?![0-9])|\+[0-9]{2}", text)[0]) - 1
        return self._refill(text, digits[:country] + self._digits(digits[country:], "phone" + digits[:country]))

    def replace(self, text: str) -> tuple[str, Counter]:
        found: Counter = Counter()
        if not _MAY_HOLD.search(text):
            return text, found
        parts, at, pos = [], 0, 0
        while (m := _FINDER.search(text, pos)) is not None:
            kind = next(k for k, v in m.groupdict().items() if v is not None and len(k) > 2)
            old = m[0]
            new = self.value(kind, old)
            while new is None and kind == "iban" and " " in old:  # the next words may look like its last groups
                old = old.rpartition(" ")[0]
                new = self.value(kind, old)
            if new is None:  # another kind of value may start inside
                pos = m.start() + 1
                continue
            found["date" if kind in ("ymd", "dmy") else kind] += 1
            parts += [text[at:m.start()], new]
            at = pos = m.start() + len(old)
        return ("".join([*parts, text[at:]]) if parts else text), found


def _replace(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            texts, counts, kinds = [], [], []
            for text in batch.column("text").to_pylist():
                new, found = names.replace(text or "")
                texts.append(None if text is None else new)
                counts.append(sum(found.values()))
                kinds.append(json.dumps(dict(sorted(found.items()))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                 pa.array(kinds, pa.string())], names=["doc_id", "text", "n_values", "kinds"])
    return run


def pseudonyms(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """(doc_id, text, n_values, kinds) of each row: the text with pseudonyms,
    how many values were replaced, and their number by kind as JSON.  A null
    text stays null and holds nothing; rows without an id and repeated rows are
    returned as they come; other columns are not read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(_replace(key), "doc_id long, text string, n_values long, kinds string")


def pseudonymise(docs: DataFrame, *, text_col: str = "text", key: bytes = KEY, back: bool = False) -> DataFrame:
    """``docs`` with its texts replaced (``back``: restored); all rows and the
    other columns stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [None if t is None else names.replace(t)[0] for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
    return docs.mapInArrow(run, docs.schema)


def restore(docs: DataFrame, *, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    return pseudonymise(docs, text_col=text_col, key=key, back=True)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all ``documents``."""
    from cobi.llm.common import table
    return pseudonyms(table(spark, sf_dir, "documents"))
