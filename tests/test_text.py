import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T


@pytest.fixture
def value(spark):
    def run(function, *args):
        row = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
        return row.select(function(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first()["v"]

    return run


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (None, ""),
        ("a​b c <표>d", "ab c d"),
        ("one\n  - 12 - \ntwo", "one\ntwo"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("a\n \n \n \nb", "a\n\n\n\nb"),
        ("　 x\t\ty 　", "x y"),
    ],
)
def test_clean_text(value, given, want):
    assert value(T.clean_text, given) == want


def test_normalize_text_strips_lines_before_blank_runs(value):
    assert value(T.normalize_text, "a\r\n \n \n \nb ") == "a\n\nb"


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("https://h/p?no=1&GotoPage=3&q=", "https://h/p?no=1"),
        ("https://h/p?skey=a#frag", "https://h/p"),
        ("https://h/p", "https://h/p"),
        ("https://h/p?a=b%20c", "https://h/p?a=b+c"),
        (None, None),
    ],
)
def test_normalize_url(value, given, want):
    assert value(T.normalize_url, given) == want


def test_ids(value):
    import hashlib

    assert value(lambda u, t: T.chunk_id(u, F.lit(3), t), "u", "é" * 300) == hashlib.sha1(("u|3|" + "é" * 256).encode()).hexdigest()[:16]
    assert value(lambda c: T.piece_id(c, F.lit(7)), "x") == hashlib.sha1(b"x|p07").hexdigest()[:16]
    assert value(lambda c: T.piece_id(c, F.lit(123)), "x") == hashlib.sha1(b"x|p123").hexdigest()[:16]


def test_titles_and_passages(value):
    assert value(T.normalize_title, " A  B > home > Home ") == "A B"
    assert value(lambda t, s, x: T.passage(t, s, x, F.lit("general")), "T", "body", "x") == "T\nx"
    assert value(lambda t, s, x: T.passage(t, s, x, F.lit("general")), "T", "제 3 조 (a)", "x") == "제 3 조 (a) | T\nx"
    assert value(lambda t, s, x: T.passage(t, s, x, F.lit("almi_cell")), "T", "S", " x ") == "x"
    assert value(T.bm25_text, "ABC 가A나 X Y2k") == "abc 가A나 X y2k"


def test_dates_and_item_ids(value):
    assert value(T.first_date, None, "on 2026.05.26 or 2025-01-01") == "2026-05-26"
    assert value(lambda d, h, o: T.item_id(d, h, o), None, None, "view('12345')") == "12345"
    assert value(lambda d, h, o: T.item_id(d, h, o), None, "javascript:void(0)", "go(GotoPage, 1234)") is None
    assert value(lambda d, h, o: T.item_id(d, h, o), "777", "?mng_no=281", None) == "777"
    assert value(lambda d, h, o: T.item_id(d, h, o), "x7", "?mng_no=281", None) == "281"
    assert value(T.post_id, "https://h/?no=&seq=5") == "5"


@pytest.mark.parametrize(("raw", "score", "reason"), [("2\nwell done", 2, "well done"), ("점수: 1", 1, ""), ("12", -1, ""), ("", -1, ""), (None, -1, ""), ("\n \n0 of 2\n a \n\nb", 0, "a b")])
def test_judged(value, raw, score, reason):
    assert value(T.judged_score, raw) == score
    assert value(T.judged_reason, raw) == reason


def test_truncate_answer(value):
    cut = lambda done: lambda c: T.truncate_answer(c, F.lit(done), " (more)")
    assert value(cut(True), "All said.") == "All said."
    assert value(cut(False), "One. Two is 1.75 of") == "One. (more)"
    assert value(cut(True), "One. Two") == "One. (more)"
    assert value(cut(False), "no end") == "no end (more)"


def test_attachment_kind(value):
    assert value(T.attachment_kind, "plan.HWPX", "x") == "hwpx"
    assert value(lambda n, h: T.attachment_kind(n, h, True), "plan.hwpx", "x") == "hwp"
    assert value(T.attachment_kind, "plan", "https://h/d.pdf?x=1") == "pdf"
    assert value(T.attachment_kind, None, None) == "other"
