"""Surrogates: gender, coreference, account numbers, names in several scripts, collisions; the query against a plain loop."""

import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terragrid.llm import pii, queries

SF = "/root/testdata/sf0.001"
KEY = b"terragrid: a key for tests only"
S = pii.Surrogates(KEY)


def test_gender_and_endings():
    out, found = S.text("Mr. Xaver Kowalski, Mrs. Zofia Kowalska, Ms. Ewelina Nowakowa, Mr. Alice Brown, госпожа Елена Петрова")
    names = [e["surrogate"].split(" ") for e in found]
    assert [n[0] for n in names] == ["Mr.", "Mrs.", "Ms.", "Mr.", "госпожа"]
    assert names[0][1] in pii.NAMES[("latin", "m")] and names[0][2].endswith("ski")
    assert names[1][1] in pii.NAMES[("latin", "f")] and names[1][2].endswith("ska")
    assert names[2][1].endswith("a") and names[2][1] not in pii.GENDER and names[2][2].endswith("owa")
    assert names[3][1] not in pii.GENDER  # a title of another gender: no listed woman's name
    assert names[4][1] in pii.NAMES[("cyrillic", "f")] and names[4][2].endswith("ова")


def test_the_same_person_in_a_text():
    out, found = S.text("John Smith spoke. Later John left; Smith stayed, Smithson too, and John Smith again.")
    full, first, last, again = (e["surrogate"] for e in found)
    assert full == again == f"{first} {last}" and "Smithson" in out
    assert not re.search(r"\b(John|Smith)\b", out)


def test_names_without_title():
    for text, old in (("Priya Sharma wrote it.", "Sharma"), ("My name is Wei Zhang.", "Zhang"), ("Name: Oluwaseun Adeyemi", "Adeyemi"), ("王小明先生来了", "王小明"), ("李娜", "李娜")):
        out, found = S.text(text)
        assert [e["type"] for e in found] == ["name"] and old not in out


@settings(max_examples=200, deadline=None)
@given(st.from_regex(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,26}", fullmatch=True))
def test_account_numbers(s):
    right = f"{s[:2]}{pii.iban_check(s[:2], s[4:]):02d}{s[4:]}"
    spaced = " ".join(right[k : k + 4] for k in range(0, len(right), 4))
    a, b = S._replace("iban", right), S._replace("iban", spaced)
    assert pii.valid_iban(right) and pii.valid_iban(a) and a == b.replace(" ", "") and a != right
    assert pii.valid_iban(S._replace("iban", s)) == pii.valid_iban(s)
    assert [e["type"] for e in S.text(f"to {spaced}.")[1]] == ["iban"]


def test_phones_and_dates():
    out, found = S.text("call 555-0199, tel. 06 12 34 56 78 or 020 7946 0958; on 01 02 2024 at 12 30 00")
    assert [e["type"] for e in found] == ["phone"] * 3 and "01 02 2024 at 12 30 00" in out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.from_regex(r"[A-Z][a-zé]{2,7}", fullmatch=True), min_size=2, max_size=30, unique=True))
def test_names_stay_distinct(names):
    new = [S.family(n) for n in names]
    assert len(set(new)) == len(names) and all(a != b and len(a) == len(b) for a, b in zip(names, new, strict=True))
    assert all(not ((a in pii.GENDER) ^ (b in pii.GENDER)) for a, b in zip(names, new, strict=True))


def test_collisions(spark):
    texts = ["Mary Jones", *(f"{n} Jones" for n in pii.NAMES[("latin", "f")]), "write to a@b.org", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["type"], r["surrogate"]) for r in pii.collisions(pii.surrogates(docs, KEY), docs).collect()}
    real = {t.lower() for t in texts[1:-3]}
    want = {S.text(t)[1][0]["surrogate"].lower() for t in texts[1:-3]} & real
    assert got == {("name", x) for x in want}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_against_a_plain_loop(spark):
    """Every text goes through, and nothing that a plain search finds in it is left."""
    plain = [r"[\w.+-]+@[\w-]+\.[\w.]+\w", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"\+\d \(\d{3}\) \d{3}-\d{4}", r"\b[0-9a-f]{40}\b", r"\b\d{16}\b"]
    old = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op4_pii_surrogates(spark, SF).collect()}
    assert got.keys() == old.keys() and sum(r["n_entities"] for r in got.values()) > 0
    for k, t in old.items():
        found = [x for p in plain for x in re.findall(p, t)]
        assert all(x not in got[k]["text"] for x in found) and got[k]["n_entities"] >= len(set(found))
        want, spans = S.text(t)
        assert got[k]["text"] == want and got[k]["n_entities"] == len(spans)
        if not found:
            assert got[k]["text"] == t
