import re
from collections import Counter

import pytest

from provenant.llm import pii

SCHEMA = "doc_id long, text string, key string, value int"
KEY = b"k"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ask the.72@mail3.example.com. now", [("email", "the.72@mail3.example.com")]),
        ("A.B@C.ORG!!", [("email", "a.b@c.org")]),
        ("call +1 (068) 555-2748 x", [("phone", "+1|0685552748")]),
        ("(02) 555 27 48", [("phone", "|025552748")]),
        ("ring +49 30 1234567 or 555-123-4567", [("phone", "+49|301234567"), ("phone", "|5551234567")]),
        ("worth 12 345 678 or 1.234.567.890 on 2021-12-31", []),
        ("at 169.122.221.182.", [("ip", "169.122.221.182")]),
        ("999.1.1.1 and 1.2.3", []),
        ("card 4952935900253052, 4539 5787 6362 1486", [("card", "4952935900253052"), ("card", "4539578763621486")]),
        ("id 123-45-6789", [("ssn", "123456789")]),
        ("pay DE89 3704 0044 0532 0130 00 soon", [("iban", "DE89370400440532013000")]),
        ('token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', [("secret", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce")]),
        ("Licensed under CC BY-NC 4.0. On 2020-01-02, 3 to 4 of 100 000 people", []),
        ("keitstlichschenverpfundmehr and internationalization-of-all", []),
        ("Ms. Anna Berg met Dr. Kurt Stein; Anna Berg left. A Berg rose.", [("first-f-latin", "anna"), ("last-latin", "berg"), ("first-n-latin", "kurt"), ("last-latin", "stein"), ("first-f-latin", "anna"), ("last-latin", "berg"), ("last-latin", "berg")]),
        ("г-н Иван Петров", [("first-m-cyrillic", "иван"), ("last-cyrillic", "петров")]),
    ],
)
def test_entities(text, want):
    assert [(k, v) for _, _, k, v in pii.entities(text)] == want


def test_many_entities_in_one_text():
    text = " ".join(f"u{i}@x.org 10.0.{i % 250}.{i % 7}" for i in range(20_000))
    assert len(pii.entities(text)) == 40_000


def test_surrogates_keep_type_and_format():
    for kind, value in [("email", "the.72@mail3.example.com"), ("ip", "9.12.221.1"), ("card", "4539578763621486"), ("card", "4539578763621487"), ("iban", "DE89370400440532013000"), ("phone", "+1|0685552748"), ("secret", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"), ("ssn", "123456789")]:
        new = pii.surrogate(KEY, kind, value, 0)
        assert new != value and new == pii.surrogate(KEY, kind, value, 0) != pii.surrogate(b"other", kind, value, 0)
        assert re.sub("[a-z]", "a", re.sub(r"\d", "0", new)) == re.sub("[a-z]", "a", re.sub(r"\d", "0", value)) or kind == "secret"
        if kind == "card":
            assert pii.luhn(new) == pii.luhn(value)
        if kind == "iban":
            assert pii._iban_ok(new)
    assert pii.surrogate(KEY, "first-f-latin", "anna", 0).endswith("a")
    assert pii.script_of(pii.surrogate(KEY, "last-cyrillic", "петров", 0)) == "cyrillic"
    assert pii.formatted("+1 (068) 555-2748", "phone", "+1|1234567890") == "+1 (123) 456-7890"
    assert pii.formatted("A.B@C.ORG", "email", "x.y@z.org") == "X.Y@Z.ORG"


def test_corpus_is_consistent(spark):
    texts = [None, "", "plain words only", "mail a.b@c.org and A.B@C.ORG", "again a.b@c.org or x.y@c.org", "call +1 (068) 555-2748", "+1 068 555 2748 too", "Ms. Anna Berg", "z" * 300_000 + " 10.0.0.1"]
    rows = [(i if i else None, t, "k", 1) for i, t in enumerate(texts)] + [(3, texts[3], "k", 1)]
    out = pii.op9_pii(spark.createDataFrame(rows, SCHEMA), KEY).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    got = {r.doc_id: r for r in out}
    assert got[None].text is None and got[1].text == "" and got[2].text == texts[2] and got[2].n_entities == 0
    a, b = re.fullmatch(r"mail (\S+) and (\S+)", got[3].text).groups()
    c, d = re.fullmatch(r"again (\S+) or (\S+)", got[4].text).groups()
    assert b == a.upper() and c == a != d and a != "a.b@c.org"
    assert re.sub(r"\D", "", got[5].text) == re.sub(r"\D", "", got[6].text) != "10685552748"
    assert got[7].text.startswith("Ms. ") and "Anna" not in got[7].text and "Berg" not in got[7].text
    assert got[8].text.startswith("z" * 300_000 + " ") and "10.0.0.1" not in got[8].text
    assert pii.op9_pii(spark.createDataFrame([], SCHEMA), KEY).count() == 0


def test_collisions_are_drawn_again(spark):
    values = [("ip", f"{a}.{b}.1.1") for a in range(10) for b in range(10)] + [("first-f-latin", x) for x in ("ana", "eva", "ida")]
    got = pii.surrogates(spark.createDataFrame(values * 2, "kind string, value string"), KEY).collect()
    assert len(got) == len(values) == len({(r.kind, r.new) for r in got})
    assert not {(r.kind, r.new) for r in got} & set(values)


def test_table_loses_all_planted_values(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    pattern = re.compile(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[0-9A-Fa-f]{40}\b")
    changed = 0
    for r in pii.op9_pii(docs, KEY).collect():
        real = set(pattern.findall(before[r.doc_id]))
        assert not any(x in r.text for x in real)
        assert bool(real) == (r.text != before[r.doc_id])
        changed += bool(real)
    assert changed > 10


def test_names_stay_the_same_person(spark):
    """Titles, orders, capitals, lone names and other scripts: one real name has one surrogate everywhere, and none is left."""
    text = "Mr John Smith went. Smith said no. John left. Dr John Smith and Mr Smith, Mr John. MR JOHN SMITH. Smith's son. Mr 王 小明 met 小明."
    rows = [(1, text), (2, "Mrs Smith and Mr Brown"), (3, "john smith forged iron")]
    got = {r.doc_id: r.text for r in pii.op9_pii(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    assert got[3] == rows[2][1] and got[2] != rows[1][1]
    first, last, wang, ming = re.match(r"Mr (\w+) (\w+) went.*Mr (\w+) (\w+) met", got[1]).groups()
    assert got[1] == text.replace("JOHN", first.upper()).replace("SMITH", last.upper()).replace("John", first).replace("Smith", last).replace("小明", ming).replace("王", wang)
    assert got[2].split()[1] == last and len({first, last, wang, ming}) == 4
    assert not {"John", "Smith", "王", "小明"} & {first, last, wang, ming} and pii.script_of(ming) == "cjk"


@pytest.mark.parametrize(("kind", "value"), [("ssn", "123456789"), ("phone", "|5551234"), ("card", "4539578763621486"), ("iban", "DE89370400440532013000"), ("secret", "b44e"), ("ip", "1.1.1.1"), ("email", "a@b.c"), ("last-latin", "li")])
def test_room_grows_with_the_attempts(kind, value):
    early, late = pii.surrogate(KEY, kind, value, 0), pii.surrogate(KEY, kind, value, 40)
    assert len(late) > len(early)
    if kind in ("ssn", "phone", "card", "iban"):
        mention = value.replace("|", "")
        assert len(pii.formatted(mention, kind, late)) > len(pii.formatted(mention, kind, early))


def test_a_key_is_needed_and_names_may_clash(spark):
    df = spark.createDataFrame([(1, "Mr Brown", 5, 6)], "doc_id long, text string, pii_key int, spot int")
    with pytest.raises(ValueError):
        pii.pseudonymize(df, b"")
    row = pii.pseudonymize(df, KEY).collect()[0]
    assert (row.pii_key, row.spot, len(row.entities)) == (5, 6, 1)
