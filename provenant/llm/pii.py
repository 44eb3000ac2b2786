"""Personal data: detection, and keyed surrogates that keep type, gender, script and format.

One real value gets one surrogate everywhere (coreference) and two real values
get two (distinctness): surrogates are drawn by a keyed hash, checked for
collisions with each other and with real values over the whole corpus, and
drawn again where they collide.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import column, finished, free_name, materialize, rewritten, split_by_key

#: Titles that announce a name, by the gender they tell ("" for none).
TITLES = {
    "m": "Mr Mister Sir Herr Herrn Monsieur Señor Don Signor г-н господин κύριος",
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Señorita Doña Signora г-жа госпожа κυρία",
    "": "Dr Prof Professor",
}
_GENDER = {form: g for g, ts in TITLES.items() for t in ts.split() for form in (t, t.upper())}
_TITLE = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, sorted(_GENDER, key=len, reverse=True))) + r")(?:\. ?| )(?=\S)")
_NAME = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")

_LOCAL = re.compile(r"[\w.%+\-]+\Z")
_DOMAIN = re.compile(r"[\w\-]+(?:\.[\w\-]+)+")
_DIGIT = re.compile(r"\d")
_SECRET = re.compile(r"(?<![\w\-])[A-Za-z0-9_\-]{20,}+(?![\w\-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)")
_CARD = re.compile(r"(?<![\d.])\d(?:[ \-]?\d){12,18}(?!\d)")
_SSN = re.compile(r"(?<![\d\-])\d{3}-\d\d-\d{4}(?![\d\-])")
_PHONE = re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]\d{2,8}){1,5}(?!\w)|(?<![\w.+])\+\d{8,15}(?!\w)")
#: Thousands of a large number, not a telephone.
_GROUPED = re.compile(r"\d{1,3}(?:[ .]\d{3})+\Z")
_DATE = re.compile(r"\d{4}[.\- ]\d\d?[.\- ]\d\d?\Z|\d\d?[.\- ]\d\d?[.\- ]\d{4}\Z")

Span = tuple[int, int, str, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _iban_ok(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def script_of(word: str) -> str:
    """The script of a word's first letter, by the first word of its Unicode name; latin where names of that script cannot be made up."""
    script = unicodedata.name(word[0], "LATIN").split()[0].lower()
    return script if script in SOUNDS or script in LETTERS else "latin"


def _emails(text: str) -> Iterator[Span]:
    at = text.find("@")
    while at >= 0:
        # no local part is longer than 64 characters
        left, right = _LOCAL.search(text[max(0, at - 64) : at]), _DOMAIN.match(text, at + 1)
        if left and right and (local := left[0].lstrip(".")):
            yield at - len(local), right.end(), "email", text[at - len(local) : right.end()].lower()
        at = text.find("@", at + 1)


def _numbers(text: str) -> Iterator[Span]:
    for m in _SECRET.finditer(text):
        s = m[0]
        if sum(c.isdigit() for c in s) >= 3 and any(c.isalpha() for c in s):
            yield m.start(), m.end(), "secret", s.lower() if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else s
    for m in _IBAN.finditer(text):
        if _iban_ok(s := m[0].replace(" ", "")):
            yield m.start(), m.end(), "iban", s
    for m in _IP.finditer(text):
        if all(int(x) < 256 for x in m[0].split(".")):
            yield m.start(), m.end(), "ip", m[0]
    for m in _CARD.finditer(text):
        yield m.start(), m.end(), "card", re.sub(r"\D", "", m[0])
    for m in _SSN.finditer(text):
        yield m.start(), m.end(), "ssn", re.sub(r"\D", "", m[0])
    for m in _PHONE.finditer(text):
        s = m[0]
        digits = re.sub(r"\D", "", s)
        told = s[0] == "+" or "(" in s or len(re.findall(r"[ .\-]", s)) >= 2
        if 7 <= len(digits) <= 15 and told and not _DATE.match(s) and not _GROUPED.match(s):
            code = re.match(r"\+(\d{1,3})(?=\D)", s)
            yield m.start(), m.end(), "phone", f"+{code[1]}|{digits[len(code[1]) :]}" if code else "|" + digits


def _names(text: str) -> Iterator[Span]:
    """Words of names after a title; the last is a family name if there are two or more, or if it stands alone.

    A name begins with a capital, or has letters without case; after a title
    in capitals all of it may be.
    """
    for m in _TITLE.finditer(text):
        at, words = m.end(), []
        capitals = m[1].isupper()
        while len(words) < 3 and (w := _NAME.match(text, at)) and not w[0][0].islower() and (not w[0].isupper() or capitals and len(w[0]) > 1):
            words.append(w)
            at = w.end()
            if text[at : at + 1] != " ":
                break
            at += 1
        gender = _GENDER[m[1]]
        for k, w in enumerate(words):
            kind = "last" if k == len(words) - 1 else f"first-{gender or 'n'}"
            yield w.start(), w.end(), f"{kind}-{script_of(w[0])}", w[0].lower()


def _again(text: str, names: list[Span]) -> Iterator[Span]:
    """Every other place of the names, as they are or in capitals, also before an apostrophe and alone."""
    known = {}
    for a, b, kind, value in names:
        for form in (text[a:b], text[a:b].upper(), text[a:b].capitalize()):
            known.setdefault(form, (kind, value))
    for m in _NAME.finditer(text):
        word = m[0] if m[0] in known else re.split("['’]", m[0])[0]
        if word in known:
            yield m.start(), m.start() + len(word), *known[word]


def entities(text: str) -> list[Span]:
    """start, end, type and canonical value of what is found, in order and disjoint; the earlier and more telling type wins.

    A name found after a title is an entity wherever it stands in the text.
    """
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += _numbers(text)
    names = list(_names(text))
    if names:
        names += _again(text, names)
    rank = {"secret": 0, "email": 1, "iban": 2, "ip": 3, "card": 4, "ssn": 5, "phone": 6}
    out: list[Span] = []  # disjoint and in order
    # of one place, the kind found after the title goes first
    for span in sorted(dict.fromkeys(found + names), key=lambda s: (rank.get(s[2], 7), s[0])):
        at = bisect(out, span)
        if (not at or out[at - 1][1] <= span[0]) and (at == len(out) or span[1] <= out[at][0]):
            out.insert(at, span)
    return out


class _Draw:
    """Numbers below given bounds from a keyed hash of a value."""

    def __init__(self, key: bytes, *what: object) -> None:
        self.key, self.seed, self.at, self.pool = key, "\x1f".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hmac.new(self.key, self.seed + b"\x1f%d" % self.at, hashlib.sha256).digest()
            self.at += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value * n >> 32

    def like(self, text: str) -> str:
        """Digits for digits, letters for letters of the same case, the rest as it is."""
        return "".join(self.digit() if c.isdigit() else self.letter(c) if c.isalpha() else c for c in text)

    def digit(self) -> str:
        return str(self.below(10))

    def letter(self, like: str) -> str:
        c = chr(97 + self.below(26))
        return c.upper() if like.isupper() else c


#: Sounds from which names are built, by script (fixed values): consonants, vowels, and endings by gender.
SOUNDS = {
    "latin": ("b d f g k l m n p r s t v".split(), "a e i o u".split(), {"m": "n", "f": "a", "n": "e", "": "r"}),
    "cyrillic": ("б в г д к л м н п р с т".split(), "а е и о у".split(), {"m": "н", "f": "а", "n": "о", "": "в"}),
    "greek": ("β γ δ κ λ μ ν π ρ σ τ".split(), "α ε ι ο υ".split(), {"m": "ς", "f": "α", "n": "ο", "": "ς"}),
}


#: First and last letters of scripts whose names are drawn letter by letter (fixed values).
LETTERS = {
    "cjk": "一龥", "hangul": "가힣", "hiragana": "あん", "katakana": "アン", "arabic": "اي", "hebrew": "את", "devanagari": "कह", "thai": "กฮ",
    "armenian": "աֆ", "georgian": "აჰ", "bengali": "কহ", "tamil": "கஹ", "ethiopic": "ሀፐ",
}


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The attempt-th surrogate of a canonical value.

    After every eight attempts formats give way to one more character or
    digit, so there is room for every value in the end.
    """
    draw = _Draw(key, kind, value, attempt)
    wide = attempt // 8
    if kind == "email":
        local, domain = value.split("@", 1)
        labels = domain.split(".")
        return draw.like(local) + "a" * wide + "@" + ".".join([draw.like(x) for x in labels[:-1]] + labels[-1:])
    if kind == "ip":
        spans = {1: (0, 10), 2: (10, 100), 3: (100, 256)}
        bounds = [(0, 256) if wide else spans[len(x)] for x in value.split(".")]
        return ".".join(str(a + draw.below(b - a)) for a, b in bounds) + (":" + "".join(draw.digit() for _ in range(wide - 1)) if wide > 1 else "")
    if kind == "card":
        body = value[0] + "".join(draw.digit() for _ in range(len(value) - 2 + wide))
        check = next(str(d) for d in range(10) if luhn(body + str(d)))
        return body + (check if luhn(value) else str((int(check) + 1 + draw.below(9)) % 10))
    if kind == "iban":
        body = draw.like(value[4:] + "0" * wide)
        rest = int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{98 - rest:02d}{body}"
    if kind == "phone":
        code, digits = value.split("|")
        return f"{code}|" + "".join(draw.digit() for _ in range(len(digits) + wide))
    if kind == "secret" and re.fullmatch("[0-9a-f]+", value):
        return "".join("0123456789abcdef"[draw.below(16)] for _ in range(len(value) + wide))
    if kind.startswith(("first", "last")):
        which, *rest = kind.split("-")
        if rest[-1] in LETTERS:
            low, high = map(ord, LETTERS[rest[-1]])
            return "".join(chr(low + draw.below(high - low + 1)) for _ in range(max(1, len(value)) + wide))
        consonants, vowels, ends = SOUNDS[rest[-1]]
        syllables = max(2, min(4, len(value) // 2)) + wide + attempt // 4
        word = "".join(consonants[draw.below(len(consonants))] + vowels[draw.below(len(vowels))] for _ in range(syllables))
        return word + ends[rest[0] if which == "first" else ""]
    return draw.like(value + "0" * wide)


def formatted(mention: str, kind: str, new: str) -> str:
    """A surrogate in the format of a mention: its separators, its case."""
    if kind in ("card", "ssn", "phone"):
        digits = iter(new.replace("+", "").replace("|", ""))
        return "".join([next(digits, "") if c.isdigit() else c for c in mention] + list(digits))
    if kind == "iban":
        chars = iter(new)
        return "".join([c if c == " " else next(chars, "") for c in mention] + list(chars))
    if kind.startswith(("first", "last")):
        return new.upper() if len(mention) > 1 and mention.isupper() else new[0].upper() + new[1:]
    if any(c.isupper() for c in mention) and mention.upper() == mention:
        return new.upper()
    return new


SPANS = "key long, start int, stop int, kind string, value string"


def found_entities(documents: DataFrame) -> DataFrame:
    """key, start, stop (code points), kind, value of all entities of documents(key, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
        names = [x.split()[0] for x in SPANS.split(", ")]
        for batch in batches:
            rows = []
            for key, text in zip(column(batch, "key"), column(batch, "text")):
                if spans := entities(text.as_py() or ""):
                    k = key.as_py()
                    rows += [(k, *s) for s in spans]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return documents.select("key", "text").mapInArrow(of, SPANS)


def name_class(kind: Column) -> Column:
    """What a value is distinct in: names of one script are one class, whatever place or title they were found with."""
    return F.when(kind.rlike("^(first|last)-"), F.concat(F.lit("name-"), F.substring_index(kind, "-", -1))).otherwise(kind)


def surrogates(mentions: DataFrame, key: bytes) -> DataFrame:
    """class, kind, value, new of mentions(kind, value): new values differ from each other and from every real one of their class.

    A name found in several kinds has one surrogate: that of a gender if one
    is told, else of the most frequent kind. Those that collide are drawn
    again, but for the smallest of each clash; a fixed one is never given up,
    so each round settles more, and room grows with the attempts.
    """

    def drawn(rows: DataFrame, attempt: int) -> DataFrame:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, values = column(batch, "kind"), column(batch, "value")
                new = [surrogate(key, k.as_py(), v.as_py(), attempt) for k, v in zip(kinds, values)]
                yield pa.RecordBatch.from_arrays([column(batch, "class"), kinds, values, pa.array(new, pa.string())], names=["class", "kind", "value", "new"])

        return rows.select("class", "kind", "value").mapInArrow(of, "class string, kind string, value string, new string")

    counts = mentions.groupBy(name_class(F.col("kind")).alias("class"), "value", "kind").count()
    told = F.struct(F.col("kind").rlike("^first-[mf]-"), "count", "kind")
    values = materialize(counts.groupBy("class", "value").agg(F.max_by("kind", told).alias("kind")), "pii-values")
    real = values.select("class", F.col("value").alias("new"))
    open_, settled, attempt = values, None, 0
    while True:
        tried = materialize(drawn(open_, attempt), "pii-tried")
        first = tried.groupBy("class", "new").agg(F.min("value").alias("value"))
        fine = first.join(real, ["class", "new"], "left_anti")
        if settled is not None:
            fine = fine.join(settled.select("class", "new"), ["class", "new"], "left_anti")
        fine = fine.join(tried, ["class", "value", "new"]).select("class", "kind", "value", "new")
        settled = materialize(fine if settled is None else settled.unionByName(fine), "pii-settled")
        open_ = materialize(open_.join(settled, ["class", "value"], "left_anti"), "pii-open")
        attempt += 1
        if open_.isEmpty():
            return settled


def pseudonymize(documents: DataFrame, key: bytes, listed_as: str = "entities") -> DataFrame:
    """documents with surrogates in their text, and column `listed_as`: start, stop (code points of the old text), kind, new value of each.

    Found are e-mail addresses, IPv4 addresses, card and account numbers,
    IBANs, social security and telephone numbers, tokens of 20 characters and
    more that mix letters and digits, and names after titles, with every other
    mention of them in the text. Whoever has the key can tell surrogates again
    from values, so there is no default. Texts without any are unchanged, null
    stays null, and repeated rows are treated alike. Other columns are carried
    along, whatever their names (but `listed_as`); an empty table gives an
    empty result.
    """
    if not key:
        raise ValueError("a secret key is needed")
    if listed_as.lower() in {c.lower() for c in documents.columns}:
        raise ValueError(f"documents already have a column {listed_as}")
    mark = free_name(documents, "pii_key")
    keyed = documents.withColumn(mark, F.xxhash64("doc_id", "text"))
    source = keyed.select(F.col(mark).alias("key"), "text")

    def listed() -> DataFrame:
        spans = materialize(found_entities(source).distinct(), "pii-spans")
        new = surrogates(spans, key).select("class", "value", "new")
        each = F.struct("start", "stop", "kind", "new")
        spans = spans.withColumn("class", name_class(F.col("kind")))
        return spans.join(new, ["class", "value"]).groupBy("key").agg(F.array_sort(F.collect_list(each)).alias(listed_as))

    lists = finished(listed, documents.sparkSession, "pii-lists").withColumnRenamed("key", mark)
    told, clean = split_by_key(keyed, lists, mark, mark)
    names = [f"`{n}`" for n in documents.columns]
    none = F.expr("cast(array() as array<struct<start:int,stop:int,kind:string,new:string>>)")
    told = told.join(lists, mark, "left").select(*names, F.coalesce(listed_as, none).alias(listed_as))
    return clean.select(*names, none.alias(listed_as)).unionByName(rewritten(told, listed_as, _replaced, keep=True))


def _replaced(text: str | None, spans: list[dict]) -> str | None:
    if text is None or not spans:
        return text
    parts, at = [], 0
    for s in spans:
        parts += [text[at : s["start"]], formatted(text[s["start"] : s["stop"]], s["kind"], s["new"])]
        at = s["stop"]
    return "".join([*parts, text[at:]])


def op9_pii(documents: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, n_entities, kinds (distinct, sorted, comma-joined) of every row of documents(doc_id, text)."""
    out = pseudonymize(documents.select("doc_id", "text"), key)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",")
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"))
