"""Text operators against literal results, on adversarial strings."""

import pytest
from pyspark.sql import functions as F

from postsift.functions import accents
from postsift.functions import text as T

# Input, cleaned text, and the newest human-written part of it.
CASES = [
    (None,
     "",
     ""),
    ("",
     "",
     ""),
    (" ",
     "",
     ""),
    ("plain",
     "plain",
     "plain"),
    ("a b c\u001cd",
     "a b c d",
     "a b c d"),
    ("Tom &amp;amp; Co &lt;b&gt;x&lt;/b&gt; &copy &#39;q&#39;",
     "Tom &amp; Co x © 'q'",
     "Tom & Co x © 'q'"),
    ("<SCRIPT>var a = '<b>';</Script>after",
     "after",
     "after"),
    ("<style>p {}</script>x</style>tail",
     "tail",
     "tail"),
    ("x < y and z > w <b",
     "x w <b",
     "x w <b"),
    ("a@b @c d@ e@f@g @",
     "EMAIL @c d@ EMAIL @",
     "EMAIL @c d@ EMAIL @"),
    ("see https://x.example/a?b=c\nnext",
     "see URL next",
     "see URL next"),
    ("İSTANBUL ſtraße ٣٤ café",
     "İSTANBUL ſtraße ٣٤ café",
     "İSTANBUL ſtraße ٣٤ café"),
    ("line\r\nline2\rline3",
     "line line2 line3",
     "line line2 line3"),
    ("Body here\nOn Monday someone wrote:\n> old",
     "Body here On Monday someone wrote: > old",
     "Body here"),
    ("Hi\n\nFrom: a\nSent: b\nTo: c\nrest",
     "Hi From: a Sent: b To: c rest",
     "Hi"),
    ("Hi\n-- Original Message --\nold",
     "Hi -- Original Message -- old",
     "Hi"),
    ("Hi\n______\nold",
     "Hi ______ old",
     "Hi"),
    ("short\nThanks,\nName",
     "short Thanks, Name",
     "short Thanks, Name"),
    ("x" * 90 + "\nThanks,\nName\nBest\nlater",
     "x" * 90 + " Thanks, Name Best later",
     "x" * 90),
    ("a\nThanks\n" + "y" * 100 + "\nThanks\nend",
     "a Thanks " + "y" * 100 + " Thanks end",
     "a Thanks " + "y" * 100 + " Thanks end"),
    ("w" * 85 + "\n--\nsig",
     "w" * 85 + " -- sig",
     "w" * 85),
    ("> all quoted\n>> twice\n  > indented\nkept",
     "> all quoted >> twice > indented kept",
     "kept"),
    ("<p>one</p><br/>two<BR >three</P >four",
     "one two three four",
     "one two three four"),
    ("word " * 900,
     ("word " * 900).strip(),
     ("word " * 900).strip()),
    ("z" * 3500,
     "z" * 3500,
     "z" * 3500),
    ("😀 emoji & more",
     "😀 emoji & more",
     "😀 emoji & more"),
    ("&notanentity; &#x41; &#66 &lt",
     "¬anentity; A B <",
     "¬anentity; A B <"),
]
# What a limit of 40 characters leaves of the longer ones: whole words, if there are any.
CUT_AT_40 = [
    ("x" * 90 + "\nThanks,\nName\nBest\nlater",
     "x" * 40),
    ("a\nThanks\n" + "y" * 100 + "\nThanks\nend",
     "a Thanks"),
    ("w" * 85 + "\n--\nsig",
     "w" * 40),
    ("word " * 900,
     "word word word word word word word word"),
    ("z" * 3500,
     "z" * 40),
]


def results(df, column):
    return [r[1] for r in sorted(df.select("seq", column).collect())]


def numbered(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "seq long, s string").repartition(3)


def test_clean_text(spark):
    assert results(T.clean_text(numbered(spark, [c[0] for c in CASES]), "s", "o"), "o") == [c[1] for c in CASES]


def test_strip_reply_noise(spark):
    assert results(T.strip_reply_noise(numbered(spark, [c[0] for c in CASES]), "s", "o", None), "o") == [c[2] for c in CASES]


def test_limits_keep_whole_words(spark):
    assert results(T.strip_reply_noise(numbered(spark, [c[0] for c in CUT_AT_40]), "s", "o", 40), "o") == [c[1] for c in CUT_AT_40]
    long = [c[0] for c in CASES if c[0] and len(c[0]) > 3000]
    got = results(T.strip_reply_noise(numbered(spark, long), "s", "o", 3000), "o")
    assert got == [("word " * 600).strip(), "z" * 3000]


def test_flattened_mail_loses_its_quotes(spark):
    rows = [(1, "s", "a@b.co", "", "", "fine On Monday Ann wrote: > old", "fine\nOn Monday Ann wrote:\n> old"), (2, "s", "a@b.co", "", "", "as it is", None)]
    df = spark.createDataFrame(rows, "seq long, subject string, `from` string, `to` string, snippet string, text string, body_raw string")
    df = df.withColumn("cc", F.lit(""))
    assert [("old" in v, "fine" in v or "as it is" in v) for v in results(T.training_text(df, "o", None), "o")] == [(False, True)] * 2
    assert [("old" in v, "fine" in v or "as it is" in v) for v in results(T.similarity_text(df, "o"), "o")] == [(False, True)] * 2


def test_masked_values_vanish_from_similarity_text(spark):
    row = spark.createDataFrame([(1, "TICK-12 due 12/05/2024 usd 450", "Ann <ann@x.example.com>", "call 5551234 now now", "see a@b.co")],
                                "seq long, subject string, `from` string, snippet string, text string")
    value = T.similarity_text(row).first()["similarity_text"]
    # The body was cleaned before lower-casing, so its EMAIL word survives; masks applied later do not.
    assert value == "subject due from x.example.com snippet call now now see email"


def test_shingles_keep_duplicates_and_short_texts(spark):
    texts = ["", "a", "a b c", "a b c d", "x x x x x", "a b c a b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, s string").withColumn("o", T.shingles(F.col("s")))

    assert results(df, "o") == [[], ["a"], ["a", "b", "c"], ["a b c", "b c d"], ["x x x", "x x x", "x x x"],
                                ["a b c", "b c a", "c a b", "a b c"]]


def test_display_name_keeps_upper_case_address(spark):
    values = ['"Ann  B" <ann@x.co>', "Bob <Bob@X.co>", "c@x.co", "", None, "<> nobody"]
    df = spark.createDataFrame(list(enumerate(values)), "seq long, s string").withColumn("o", T.display_name(F.col("s")))
    assert results(df, "o") == ["Ann B", "Bob <Bob@X.co>", "", "", "", "nobody"]


def test_normalize_label(spark):
    values = [" Action Needed ", "R&D", "__x--y__", "", None, " Fyi "]
    df = spark.createDataFrame(list(enumerate(values)), "seq long, s string").withColumn("o", T.normalize_label(F.col("s")))
    assert results(df, "o") == ["action_needed", "r_and_d", "x_y", "", "", "fyi"]


def test_strip_accents(spark):
    values = ["é", "é", "ß", "ﬁle ½", "Ångström ǆ", "한글", "͏", "日本", None, "ª²"]
    df = spark.createDataFrame(list(enumerate(values)), "seq long, s string")
    expected = ["e", "e", "\xdf", "file 1\u20442", "Angstrom dz", "\u1112\u1161\u11ab\u1100\u1173\u11af", "\u034f", "\u65e5\u672c", "", "a2"]
    assert results(accents.strip_accents(df, "s", "o"), "o") == expected


def test_rules_take_the_first_label(spark):
    values = ["Production issue, invoice attached", "wholesale neutral", "Random note", "FYI: meeting", "please approve the payment"]
    df = spark.createDataFrame(list(enumerate(values)), "seq long, s string")
    assert results(T.classify_by_rules(df, "s", "o"), "o") == ["urgent", "payment", None, "fyi", "action_needed"]


def test_guarded_patterns_change_what_the_plain_ones_change(spark):
    from postsift import constants as K

    odd = ["http://a.b/c x", "ftp://a https:// b", "me@x.com, a@b", "\u212a@x.com tick-12 \u017fale-4 a-\u0663", "#12 a#34 #", "1/2/2024 3:4 \u0661.\u0662",
           "12345 x1234 9999 \u0661\u0662\u0663\u0664", "1.5 2,3 4 a5", "usd num eur . NUM gbp.num", "deadbeef cafebabe1 xdeadbeef 0123456789ab", "plain", ""]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    for (pattern, repl), (needed, start) in zip(K.SIMILARITY_MASKS, T._MASK_NEEDS, strict=True):
        found = rows.select(T._where(F.col("t"), needed, f"(?iuU){start}{pattern}", repl).alias("a"),
                            F.regexp_replace("t", f"(?iuU){pattern}", repl).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in found), pattern
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["\u200b", "\u180e", "a"]
    ends = spark.createDataFrame([(f"{b}x{b} {b}y{b}{b}",) for b in blanks] + [("",), (" \t ",), (None,)], "t string")
    trimmed = ends.select(T.strip_space(F.col("t")).alias("a"), F.regexp_replace("t", rf"(?U)^{T.SPACE}+|{T.SPACE}+\z", "").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in trimmed)


def test_shingles_pass_over_double_spaces(spark):
    texts = ["a b c", "a b c d", "ab cd ef  gh ij kl mn", " a b c d", "a b c d ", ""]
    got = [r["s"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.shingles(F.col("t")).alias("s")).collect()]
    assert got == [["a", "b", "c"], ["a b c", "b c d"], ["ab cd ef", "gh ij kl", "ij kl mn"], ["a", "b", "c", "d"], ["a b c", "b c d"], []]
