from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.llm import canonical
from tests.conftest import rows

ENTRIES = [("account_number", ["acct_nbr"]), ("birth_date", ["dob", "date_of_birth", None]), ("country_of_residence", None), (None, ["x"])]
WORDS = st.text("abcn", max_size=7)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS, WORDS)
def test_distance_is_a_metric(a, b, c):
    d = canonical.distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)


def test_distance_values():
    d = canonical.distance
    assert (d("ab", "ba"), d("ca", "abc"), d("abc", ""), d("account", "acocunt")) == (1, 2, 3, 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcdn", min_size=1, max_size=8), min_size=1, max_size=40, unique=True), WORDS)
def test_tree_finds_what_a_scan_finds(forms, value):
    entries = [(f, i % 3 == 0, f"n{i}") for i, f in enumerate(forms)]
    hits = [(d, s, n) for f, s, n in entries if (d := canonical.distance(value, f)) <= min(canonical.radius(f, s), canonical.radius(value, s))]
    exact = next(((0, s, n) for f, s, n in entries if f == value), None)
    assert canonical.Tree(entries).nearest(value) == (exact or min(hits, default=None))


def frame(spark):
    names = ["accountNumber", "ACCT-NBR", "tbl.acocunt number_v2", "number_account", "account nmbr", "  DOB ", "birth city", "ａｃｃｏｕｎｔ＿ｎｕｍｂｅｒ", "residence country", "", "   ", None, "!!!", "account manager", "z" * 50_000, "DOB", "DOB", "account_number_v2", "tbl.dob", "tbl_account_number", "BirthDate_v2", "tblCountryResidence", "residence_country_v2"]
    return spark.createDataFrame([(i, n, "x", "y") for i, n in enumerate(names)], "obs_id bigint, raw_name string, preferred_name string, raw string")


WANT = {0: "account_number", 1: "account_number", 2: "account_number", 3: "account_number", 4: "account_number", 5: "birth_date", 6: "", 7: "account_number", 8: "country_of_residence", 12: "", 13: "", 14: "", 15: "birth_date", 16: "birth_date", 17: "account_number", 18: "birth_date", 19: "account_number", 20: "birth_date", 21: "country_of_residence", 22: "country_of_residence"}


def test_match(spark, monkeypatch):
    entries = spark.createDataFrame(ENTRIES, "preferred_name string, aliases array<string>")
    got = {r.obs_id: r.preferred_name for r in canonical.match(frame(spark), entries).collect()}
    assert got == WANT
    monkeypatch.setattr(canonical, "TREE_FORMS", 24)
    monkeypatch.setattr(canonical, "SPREAD", 2)
    assert {r.obs_id: r.preferred_name for r in canonical.match(frame(spark), entries).collect()} == WANT


def test_empty(spark):
    entries = spark.createDataFrame(ENTRIES, "preferred_name string, aliases array<string>")
    assert rows(canonical.match(frame(spark).limit(0), entries)) == []
    assert {r.preferred_name for r in canonical.match(frame(spark), entries.limit(0)).collect()} == {""}


def test_added_words_are_learnt(spark):
    """Affixes that no list names, of any length, are found by the entries that they leave behind; others stay."""
    entries = spark.createDataFrame(ENTRIES, "preferred_name string, aliases array<string>")
    names = [*(f"{n}_prod" for n in ("account_number", "birth_date", "residence_country")), *(f"legacy.{n}" for n in ("dob", "accountNumber", "country_of_residence")), "legacy_account_nubmer_prod", "birth_place", "account_place", "once_dob", "prod"]
    got = {r.raw_name: r.preferred_name for r in canonical.match(spark.createDataFrame([(n,) for n in names], "raw_name string"), entries).collect()}
    want = ["account_number", "birth_date", "country_of_residence", "birth_date", "account_number", "country_of_residence", "account_number", "", "", "", ""]
    assert got == dict(zip(names, want))
    got = {r.raw_name: r.preferred_name for r in canonical.match(spark.createDataFrame([("once_dob",)], "raw_name string"), entries, added_to=1).collect()}
    assert got == {"once_dob": "birth_date"}


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", min_size=1, max_size=63), st.lists(st.text("abcde", max_size=6), min_size=1, max_size=5))
def test_bit_parallel_distance(form, values):
    import numpy as np

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    assert list(canonical.levenshtein(form, np.array([[*map(ord, v), *[-1] * (6 - len(v))] for v in values]))) == [plain(form, v) for v in values]


def test_shortened_forms_take_an_edit_for_six_letters():
    assert [canonical.radius("x" * n, True) for n in (2, 3, 11, 12, 30)] == [0, 1, 1, 2, 2]
    assert [canonical.radius("x" * n, False) for n in (2, 3, 5, 6, 30)] == [0, 1, 1, 2, 2]
