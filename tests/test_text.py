from pyspark.sql import functions as F

from textquarry.functions import arrays, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_letters_and_digits_are_folded(spark):
    norm = text.normalize_search(F.col("t"))
    assert one(spark, norm, t="كيمي") == one(spark, norm, t="کیمی")
    assert one(spark, norm, t="۱۲٣") == "123"
    assert one(spark, norm, t="می‌شود") == one(spark, norm, t="می شود")
    assert "co2" in one(spark, norm, t="گاز CO2")
    assert one(spark, norm, t=None) == ""


def test_tokens(spark):
    tok = text.tokenize(F.col("t"))
    assert one(spark, tok, t="چیست؟") == ["چیست؟"]
    assert one(spark, tok, t="être 1.5 h-o na+ a+-b") == ["tre", "1.5", "h-o", "na", "a", "b"]
    assert one(spark, text.token_count(F.col("t")), t="") == 0


def test_display_keeps_lines(spark):
    assert one(spark, text.normalize_display(F.col("t")), t=" a \t b\r\n\r\n  c\x0bd \r e ") == "a b\nc d\ne"


def test_nfkc_only_where_needed(spark):
    df = spark.createDataFrame([("ﬁne ①",), ("plain",), (None,), ("کتاب",)], "t string")
    assert sorted(r.t for r in df.select(text.nfkc(F.col("t")).alias("t")).collect()) == ["", "fine 1", "plain", "کتاب"]


def test_page_number_line_goes(spark):
    clean = text.clean_page_text(F.col("t"), F.col("p"))
    assert one(spark, clean, t="one\n۱۲\n13", p=12) == "one\n13"


def test_headings(spark):
    head = text.section_heading(F.col("t"), F.lit("عنوان، اصلی"))
    assert one(spark, head, t="12\nاین یک جمله است:\nپیوند هیدروژنی …\nx") == "پیوند هیدروژنی"
    assert one(spark, head, t="a = b\n" + "w " * 30 + "\n...") is None
    assert one(spark, head, t="عنوان اصلی: این کتاب درباره آب و هوا و زمین است.") is not None


def test_kinds_of_text(spark):
    kind = text.content_type(F.col("t"))
    assert [one(spark, kind, t=t) for t in ("تمرین جدول", "نمودار", "شکل ۱", "شکل" + "x" * 500, "x")] == ["exercise", "table_or_chart", "caption", "prose", "prose"]


def test_citations(spark):
    df = spark.createDataFrame([("کتاب شیمی دهم", [57, 56, 56]), ("کتاب", [5]), ("کتاب", [])], "t string, p array<int>")
    got = [r[0] for r in df.select(text.citation_label(F.col("t"), F.col("p"))).collect()]
    assert got == ["کتاب شیمی دهم، صفحه‌های ۵۶، ۵۷", "کتاب، صفحه ۵", "کتاب"]
    assert one(spark, text.citation_id(F.col("b"), F.col("p")), b="B", p="B:parent-0001") == "B:parent-0001"
    assert one(spark, text.citation_id(F.col("b"), F.col("p")), b="B", p="p1") == "B:p1"


def test_slugs_and_data_urls(spark):
    assert one(spark, text.slug(F.col("t")), t="openai/model v1!") == "openai-model-v1"
    assert one(spark, text.slug(F.col("t")), t="///") == "model"
    assert one(spark, text.is_image_data_url(F.col("t")), t="data:image/png;base64,aGk=") is True
    assert one(spark, text.is_image_data_url(F.col("t")), t="data:image/png;base64,not-valid-@@") is False
    assert one(spark, text.image_data_url(F.col("t"), F.lit(b"hi")), t="a/shot.PNG") == "data:image/png;base64,aGk="
    assert one(spark, text.image_data_url(F.col("t"), F.lit(b"hi")), t="a/shot.txt") is None


def test_sentences(spark):
    assert one(spark, text.sentences(F.col("t")), t="One. Two?  سه؟ چهار؛ x") == ["One.", "Two?", "سه؟", "چهار؛", "x"]


def test_set_and_vector_helpers(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"], [3.0, 4.0]), ([], [], [0.0, 0.0])], "a array<string>, b array<string>, v array<double>")
    rows = df.select(arrays.jaccard(F.col("a"), F.col("b")), arrays.coverage(F.col("a"), F.col("b")), arrays.l2_normalize(F.col("v"))).collect()
    assert tuple(rows[0]) == (1 / 3, 0.5, [0.6, 0.8]) and tuple(rows[1]) == (0.0, 0.0, [0.0, 0.0])


def test_minmax_and_upper_median(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, None), (2, 5.0), (2, 5.0)], "q int, s double")
    got = sorted((r.q, r.m) for r in df.select("q", arrays.minmax(F.col("s"), "q").alias("m")).collect() if r.m is not None)
    assert got == [(1, 0.0), (1, 1.0), (2, 1.0), (2, 1.0)]
    assert df.agg(arrays.upper_median(F.col("s"))).first()[0] == 5.0


def test_stable_characters_need_no_normaliser(spark):
    import re
    import unicodedata

    stable = [c for c in map(chr, range(0x2100)) if re.fullmatch(f"[{text.STABLE}]", c)]
    assert len(stable) > 400
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in stable)
    pairs = "".join(a + b for a in stable for b in stable)
    assert unicodedata.normalize("NFKC", pairs) == pairs
    odd = ["ﬁne", "été", "½ ① ｆｕｌｌ", "…", "كتاب ﻻ", "plain", "Straße – „ja“", "", None, "آ"]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select(text.nfkc(F.col("t")).alias("n"))
    assert [r.n for r in got.collect()] == [unicodedata.normalize("NFKC", t or "") for t in odd]


def test_texts_without_odd_characters_skip_the_slow_patterns(spark):
    odd = [None, "", " ", "a", " a", "a　", "\x85a b ", "a\nb", "ﬁx", "xé", "x́", "كي", "① 1", "plain text", " "]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string")
    t = F.coalesce("x", F.lit(""))
    full = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))
    plain = F.regexp_replace("x", f"^{text.SPACE}+|{text.SPACE}+$", "")
    for r in rows.select(text.nfkc(F.col("x")).alias("a"), full.alias("b"), text.strip(F.col("x")).alias("c"), plain.alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d)
    plan = rows.select(text.strip(F.col("x")))._jdf.queryExecution().toString() + rows.select(text.nfkc(F.col("x")))._jdf.queryExecution().toString()
    assert plan.count("substring(x") and "[^\\x00-\\x7f]" in plan


def test_plain_texts_take_a_short_way_to_the_same_result(spark):
    """The short ways look for few plain strings and one range; the long ways are written out here."""
    pool = ["a", "Z", "K", "9", "+", "-", ".", " ", "\n", "\r", "\t", "\f", "\x0b", "\x1c", "\x1f", "\x85", "\u00a0", "\u00c9", "\u0130", "\u212a", "\u200a", "\u200e", "\u0640", "\u0643", "\u064b", "\u06f5", "\u2028"]
    rows = [(a + x + b + y,) for x in pool for y in pool for a in ("", "A ", "b") for b in ("", " c", "D")] + [(None,)]
    df, c = spark.createDataFrame(rows, "t string"), F.col("t")
    long = text._comparable(c)
    pairs = [
        (text.normalize_display(c), text._displayed(c)),
        (text.tokenize(c), F.regexp_extract_all(long, F.lit(text.TOKEN), F.lit(0))),
        (text.normalize_search(c), F.array_join(F.regexp_extract_all(long, F.lit(text.SEARCHABLE), F.lit(0)), " ")),
        (text.token_count(c), F.regexp_count(long, F.lit(text.TOKEN))),
        (text.lines(c), F.split(c, text.LINE_BREAK)),
    ]
    for short, full in pairs:
        assert df.filter(~short.eqNullSafe(full)).limit(5).collect() == []
    assert df.filter(text._western(c)).count() > 1000


def test_a_page_is_cleaned_with_its_text_worked_out_once(spark):
    """What cleaning is made of looks at its text often; the text was normalised again for each look."""
    from textquarry.sources.io import page_rows

    raw = spark.createDataFrame([("b", "t", "f", 7, " a b \r\n\n 7 \nﬁn \n 12"), ("b", "t", "f", 8, None)], "book_id string, book_title string, source_file string, pdf_page int, raw_text string")
    rows = page_rows(raw).select("pdf_page", "display_text", "quality.characters", "quality.tokens", "quality.has_text")
    assert sorted(map(tuple, rows.collect())) == [(7, "a b\nfin\n12", 10, 4, True), (8, "", 0, 0, False)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Normalizer") == 1
