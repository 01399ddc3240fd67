"""Surrogates: nothing personal stays, kinds and formats do, equal stays equal and distinct stays distinct."""

import re

import pytest

from millrace.llm import surrogates

KEY = "a key"
TEXTS = [
    (1, "Write to anna.berg@example.com or ANNA.BERG@Example.com, call +49 30 123456 or (555) 123-4567. IP 10.0.200.7."),
    (2, "Mr. Carver met Mrs. Dawson; Mr. Carver paid with 4111 1111 1111 1111 (ssn 078-05-1120)."),
    (3, "господин Орлов и госпожа Орлова. Again anna.berg@example.com!"),
    (4, "Mary Ashford and John Ashford and Mary Carver"),
    (5, None),
    (6, ""),
    (7, "nothing personal, 12:30 on 2024-01-01, version 1.2.3"),
    (None, "mail bob_1@site.org"),
]


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def found(spark, rows):
    return {r.doc_id: r for r in surrogates.replace_pii(spark.createDataFrame(rows, "doc_id bigint, text string"), KEY).collect()}


def test_kinds_formats_and_coreference(spark):
    out = found(spark, TEXTS)
    assert out[1].kinds == "email,email,phone,phone,ip" and out[2].kinds == "name,name,name,card,ssn"
    assert out[5].text is None and out[6].text == "" and out[7].text == TEXTS[6][1] and out[7].n_entities == 0
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", s)))
    for i in (1, None):
        before = next(t for d, t in TEXTS if d == i)
        assert out[i].text != before
        if i is None:
            assert shape(out[i].text) == shape(before)
    mails = [re.findall(r"[\w.]+@[\w.]+", out[i].text) for i in (1, 3)]
    assert mails[0][0] == mails[1][0].rstrip("!") and mails[0][0].endswith(".com") and "berg" not in out[1].text.lower()
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", out[2].text)[0]
    assert card != "4111 1111 1111 1111" and card[0] == "4" and luhn(card.replace(" ", ""))
    men, women = re.findall(r"Mr\. (\w+)", out[2].text), re.findall(r"Mrs\. (\w+)", out[2].text)
    assert men[0] == men[1] != women[0] and "Carver" not in out[2].text and "Dawson" not in out[2].text
    man, woman = re.search(r"господин (\w+) и госпожа (\w+)", out[3].text).groups()
    assert man in surrogates.MALE_SURNAMES_CYRILLIC and woman in surrogates.FEMALE_SURNAMES_CYRILLIC
    a, b, c = re.fullmatch(r"(.+) and (.+) and (.+)", out[4].text).groups()
    assert a.split()[0] == c.split()[0] in surrogates.FEMALE_NAMES and b.split()[0] in surrogates.MALE_NAMES and a.split()[1] == b.split()[1] != c.split()[1]


def test_no_collisions_over_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    mapped = surrogates.mapping(docs, KEY)
    assert mapped.count() > 10 and surrogates.collisions(mapped).count() == 0
    assert mapped.where("kind = 'email' and original = surrogate").count() == 0
    after = {r.doc_id: r.text for r in surrogates.replace_pii(docs, KEY).collect()}
    long = [r for r in mapped.where("kind in ('email', 'card', 'iban')").collect()]
    assert not [r for r in long if r.original in after[r.doc_id]]


def test_permutation_is_one_to_one(spark):
    from pyspark.sql import functions as F

    rows = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("v"))
    assert rows.select(surrogates.permuted(F.col("v"), "x", "key").alias("p")).where(F.col("p").rlike("^[0-9]{4}$")).distinct().count() == 10_000


def test_more_names_than_the_list(spark):
    names = [f"Mr. {a}{b}son" for a in "ABCDEFGHIJ" for b in ("ar", "el", "in", "or")]
    out = found(spark, [(1, "; ".join(names))])[1]
    new = re.findall(r"Mr\. (\w+)", out.text)
    assert len(new) == len(set(new)) == len(names) and not set(new) & {n[4:] for n in names}


def test_names_of_a_corpus(spark):
    """Bare mentions go too; one surrogate for a name in all documents, and one name for a surrogate."""
    rows = [(1, "Smith's friend, Mr. Smith, left. Then Smith (Mr. Smith's car) met Smithson; write to Smith.j@example.com")]
    rows += [(100 + i, f"Mrs. {a}{b} and Dr. Smith") for i, (a, b) in enumerate((a, b) for a in ("Bar", "Mor", "Kel", "Tan", "Wes", "Li", "Ро", "Σα") for b in ("ton", "dale", "ova", "n", "в", "ева"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r for r in surrogates.replace_pii(docs, KEY).collect()}
    a, b, c, d = re.fullmatch(r"(\w+)'s friend, Mr\. (\w+), left\. Then (\w+) \(Mr\. (\w+)'s car\) met Smithson; write to \S+@\S+", out[1].text).groups()
    assert a == b == c == d != "Smith" and out[1].n_entities == 5 and "Smith.j" not in out[1].text
    others = [re.fullmatch(r"Mrs\. (\S+) and Dr\. (\S+)", out[i].text).groups() for i, _ in rows[1:]]
    assert {s for _, s in others} == {a} and len({n for n, _ in others} | {a}) == len(rows)
    assert not [t for i, t in rows[1:] if t.split()[1] in out[i].text]
    mapped = surrogates.mapping(docs, KEY)
    assert surrogates.collisions(mapped).count() == 0
    clash = spark.createDataFrame([(1, "name", "Mr. A", "Mr. X"), (2, "name", "Mr. B", "Mr. X")], mapped.schema)
    assert [(r.several, r.value) for r in surrogates.collisions(clash).collect()] == [("originals", "Mr. X")]


def test_odd_rows(odd, odd_rows, empty):
    out = surrogates.pseudonymize(odd, KEY)
    assert out.columns == odd.columns and out.count() == len(odd_rows)
    assert surrogates.replace_pii(empty, KEY).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_key_is_needed(odd):
    with pytest.raises(ValueError):
        surrogates.replace_pii(odd, "")


LONG = {
    "mail host": "x@" + "a." * 400_000 + "com",
    "mail name": "a." * 400_000 + "@x.com",
    "digits": "1" * 1_000_000,
    "dotted": "1." * 500_000,
    "groups": "1234 " * 200_000,
    "hyphens": "Mr. A" + "-" * 1_000_000,
    "joined": "Mr. Ab" + "-b" * 500_000 + " x",
    "possessives": "Mr. Ab" + "'s" * 500_000,
    "capitals": "A" * 1_000_000 + " Mr. Ab",
    "pluses": "+1 " * 300_000,
    "account": "DE89 " * 200_000,
    "titles": "Mr. " * 200_000,
}


def test_long_runs_of_each_pattern(spark):
    """A million characters of what each pattern repeats: the job lives, and keeps the rows."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(LONG.values())], "doc_id bigint, text string").repartition(6)
    out = {r.doc_id: r.n_entities for r in surrogates.replace_pii(docs, KEY).select("doc_id", "n_entities").collect()}
    assert len(out) == len(LONG) and out[0] == out[1] == 1


def test_many_names_of_all_scripts_leave_no_original(spark):
    ends = ("ton", "dale", "wick", "ström", "ček", "ñez", "çois")
    latin = [a + b for a in ("Bar", "Mor", "Kel", "Tan", "Öst", "Ég") for b in ends]
    cyrillic = [a + b for a in ("Леонть", "Карпат", "Щерб", "Юрь", "Тимоф") for b in ("ев", "ова", "ин", "ский", "енко", "ак")]
    greek = [a + b for a in ("Παπα", "Γεωργ", "Νικολ") for b in ("δόπουλος", "ιάδης", "άκης")]
    other = ["Ğündoğan", "Ţepeş", "Ƙano", "Łőrincz"]
    names = latin + cyrillic + greek + other
    titles = ["Mr.", "господин", "Dr."]
    rows = [(1, "; ".join(f"{titles[i % 3]} {n}" for i, n in enumerate(names)))] + [(2 + i, f"{n.upper()} wrote to Prof. {n}, and {n} wrote back") for i, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r.text for r in surrogates.replace_pii(docs, KEY).collect()}
    new = [re.fullmatch(r"\S+ (\S+)", part)[1] for part in out[1].split("; ")]
    assert len(set(new)) == len(names) and not set(new) & set(names)
    for i, n in enumerate(names):
        assert out[2 + i] == f"{new[i].upper()} wrote to Prof. {new[i]}, and {new[i]} wrote back"
        assert n not in out[1] and n.lower() not in out[2 + i].lower()
    assert surrogates.collisions(surrogates.mapping(docs, KEY)).count() == 0


def test_cues_before_names(spark):
    rows = [(1, "my name is Talia Brenner. Ask TALIA or Brenner's team"), (2, "Меня зовут Тимофей, привет"), (3, "Signed by the board; Full name: Ort Vann")]
    out = found(spark, rows)
    assert out[1].n_entities == 3 and "Talia" not in out[1].text and "Brenner" not in out[1].text and "TALIA" not in out[1].text
    assert out[2].n_entities == 1 and "Тимофей" not in out[2].text
    assert out[3].n_entities == 1 and out[3].text.startswith("Signed by the board; Full name: ")


def test_against_a_plain_version(spark, small):
    """Entities of the table by Python's own patterns, replaced by the surrogates of the mapping."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    pairs = {(r.kind, r.original): r.surrogate for r in surrogates.mapping(docs, KEY).collect()}
    assert all(a != b for (_, a), b in pairs.items())
    import regex

    # Python has no recursion limit to dodge; names of the pattern need its letter classes
    patterns = {k: regex.compile(p) for k, p in surrogates.PATTERNS.items()}
    for r in surrogates.replace_pii(docs, KEY).join(docs.withColumnRenamed("text", "before"), "doc_id").collect():
        kinds, at, out, text = [], 0, [], r.before or ""
        while at <= len(text):
            hits = [(m.start(), i, k, m) for i, (k, p) in enumerate(patterns.items()) if (m := p.search(text, at))]
            if not hits:
                break
            start, _, kind, m = min(hits, key=lambda h: h[:2])
            out += [text[at:start], pairs[kind, m[0]]]
            kinds.append(kind)
            at = m.end()
        if "name" not in kinds:
            assert r.kinds == ",".join(kinds) and r.n_entities == len(kinds) and r.text == "".join([*out, text[at:]])


def test_names_of_any_form(spark):
    """Initials, small words, any number of words, capitals, scripts without case: nothing of a name stays but its small words."""
    rows = [
        (1, "Mr. J. Smith and Mr. John Q. Smith met Ms. Anna van der Berg. Smith left; Berg stayed, SMITH's car."),
        (2, "my name is 李娜，李娜说。我叫王小明，王小明。"),
        (3, "Prof. J.R.R. Tolkien wrote; Tolkien"),
        (4, "Patient: Ort Vann Delgado Reyes; Delgado"),
        (5, "me llamo María de la Cruz y Gómez. Gómez"),
        (6, "Mr. SMITH and Smith"),
        (7, "signed by O'Brien-Smith. O'BRIEN-SMITH"),
        (8, "اسمي أحمد"),
        (9, "Full name: " + "Ab" * 120),
    ]
    out = {i: r.text for i, r in found(spark, rows).items()}
    gone = {1: ("Smith", "Berg", "SMITH", "John", "Anna", " J.", "Q."), 2: ("李", "娜", "王", "小", "明"), 3: ("Tolkien", "J.R.R"), 4: ("Ort", "Vann", "Delgado", "Reyes"), 5: ("María", "Cruz", "Gómez"), 6: ("SMITH", "Smith"), 7: ("O'B", "Smith", "SMITH"), 8: ("أحمد",), 9: ("Abab",)}
    assert [(i, w) for i, words in gone.items() for w in words if w in out[i]] == []
    a, b, c, d, e, f = re.fullmatch(r"Mr\. \w\. (\w+) and Mr\. \w+ \w\. (\w+) met Ms\. \w+ van der (\w+)\. (\w+) left; (\w+) stayed, (\w+)'s car\.", out[1]).groups()
    assert a == b == d and c == e and f == a.upper()
    x, y = re.fullmatch(r"my name is (\w\w)，\1说。我叫(\w\w\w)，\2。", out[2]).groups()
    assert all("一" <= ch <= "龥" for ch in x + y)
    assert re.fullmatch(r"Mr\. ([A-Z]+) and (\w+)", out[6]).group(1) == out[6].split()[-1].upper() == a.upper()
    big = re.fullmatch(r"signed by (\S+)\. (\S+)", out[7])
    assert big[1].upper() == big[2] and re.fullmatch(r"[A-Z]'[A-Z][a-z]{4}-[A-Z][a-z]{4}", big[1])


def test_one_value_in_several_formats(spark):
    rows = [(1, "555-123-4567, (555) 123-4567, 555.123.4567, +1 555-123-4567; +49 30 123456 or +4930123456"), (2, "John.Smith@acme.com john.smith@acme.com JOHN.SMITH@ACME.COM"), (3, "DE89 3704 0044 0532 0130 00 or DE89370400440532013000")]
    out = {i: r.text for i, r in found(spark, rows).items()}
    digits = [re.sub(r"\D", "", p) for p in re.split("[,;] | or ", out[1])]
    assert digits[0] == digits[1] == digits[2] == digits[3][1:] != "5551234567" and digits[4] == digits[5] and digits[3][0] == "1" and digits[4][:2] == "49"
    assert re.sub(r"\d", "9", out[1]) == re.sub(r"\d", "9", rows[0][1])
    a, b, c = out[2].split()
    assert a.lower() == b == c.lower().removesuffix(".com") + ".com" and a[0].isupper() and a[5].isupper() and "smith" not in out[2].lower()
    assert len({x.replace(" ", "") for x in out[3].split(" or ")}) == 1 and "3704" not in out[3]
    mapped = surrogates.mapping(spark.createDataFrame(rows, "doc_id bigint, text string"), KEY)
    assert surrogates.collisions(mapped).count() == 0


def test_common_words_stay(spark):
    """Within a name they go."""
    rows = [(1, "Mr. May said we may go in May"), (2, "Ms. Will Smith: Will you? WILL YOU"), (3, "my name is Will. Will!"), (4, "Mr. Smith I am here"), (5, "Signed by the board")]
    out = {i: r.text for i, r in found(spark, rows).items()}
    assert re.fullmatch(r"Mr\. (?!May)\w+ said we may go in May", out[1])
    assert re.fullmatch(r"Ms\. (?!Will)\w+ (?!Smith)\w+: Will you\? WILL YOU", out[2])
    assert re.fullmatch(r"my name is (?!Will)\w+\. Will!", out[3])
    assert out[4].endswith(" I am here") and "Smith" not in out[4] and out[5] == rows[4][1]


def test_a_collision_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "collisions", lambda m: m.selectExpr("kind", "'originals' as several", "surrogate as value", "2 as n"))
    with pytest.raises(RuntimeError, match="one-to-one"):
        found(spark, TEXTS)
