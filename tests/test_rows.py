"""Order-sensitive selection, splits and sources."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from postsift.operators import grouping as G
from postsift.operators import labelling as L
from postsift.operators import rows as R
from postsift.operators import scoring as C
from postsift.operators import senders as S
from postsift.schemas import raw_message
from postsift.sources import mail as M

# Published label counts and the validation sizes, total and top-up they must give.
COUNTS = {"action_needed": 1347, "awaiting_reply": 59, "done": 161, "follow_up": 52, "fyi": 2706, "marketing": 5, "meeting": 146,
          "misc": 9, "newsletter": 53, "payment": 1446, "urgent": 86}
VALID = {"action_needed": 202, "awaiting_reply": 9, "done": 24, "follow_up": 8, "fyi": 406, "marketing": 1, "meeting": 22,
         "misc": 1, "newsletter": 8, "payment": 217, "urgent": 13}


@pytest.fixture(scope="module")
def corpus(spark):
    sizes = spark.createDataFrame(list(COUNTS.items()), "label string, n int")
    rows = sizes.select("label", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    return rows.withColumn("seq", F.row_number().over(R.W.orderBy("label", "i")).cast("long")).withColumn(
        "message_id", F.col("seq").cast("string")).cache()


def test_published_split_and_oversample_sizes(corpus):
    split = R.stratified_split(corpus).cache()
    valid = {r["label"]: r["n"] for r in C.label_counts(split.filter("split = 'valid'")).collect()}
    assert valid == VALID and sum(valid.values()) == 911
    train = split.filter("split = 'train'")
    assert train.count() == 5159
    assert R.oversample(train, 50).count() == 5258
    assert R.oversample(train, 0).count() == 5159


def test_split_keeps_a_single_row_in_train(spark):
    df = spark.createDataFrame([(1, "1", "a"), (2, "2", "b"), (3, "3", "b")], "seq long, message_id string, label string")
    got = {r["label"]: r["n"] for r in R.stratified_split(df).filter("split = 'valid'").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == {"b": 1}


def test_keep_one_first_and_last(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, None, "c"), (4, None, "d")], "seq long, k string, v string")
    assert {r["v"] for r in R.keep_one(df, ["k"]).collect()} == {"a", "c"}
    assert {r["v"] for r in R.keep_one(df, ["k"], last=True).collect()} == {"b", "d"}


def test_rank_within_is_exact_across_buckets(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), (F.col("id") % 3 == 0).cast("string").alias("k"))
    ranked = R.rank_within(df, ["k"], F.floor(F.col("seq") / 50), [F.col("seq")], "r")
    want = df.withColumn("r", F.row_number().over(R.W.partitionBy("k").orderBy("seq")).cast("long"))
    assert ranked.select("seq", "r").exceptAll(want.select("seq", "r")).isEmpty()


def test_read_emails_keeps_file_and_line_order(spark, tmp_path):
    paths = []
    for name, ids in (("b", ["1", "2", "3"]), ("a", ["4", "5"])):
        path = tmp_path / f"{name}.jsonl"
        path.write_text("\n".join(json.dumps({"message_id": i, "from": "x"}) + "\n" for i in ids), encoding="utf-8")
        paths.append(str(path))
    df = M.read_emails(spark, paths)
    assert [r["message_id"] for r in df.orderBy("seq").collect()] == ["1", "2", "3", "4", "5"]
    assert df.select("seq").distinct().count() == 5


def test_bad_lines_fail_by_default_and_drop_on_resume(spark, tmp_path):
    path = tmp_path / "out.jsonl"
    path.write_text('{"message_id":"1"}\n{broken\n{"message_id":""}\n', encoding="utf-8")
    with pytest.raises(Exception):
        M.read_emails(spark, [str(path)]).collect()
    assert [r["message_id"] for r in L.existing_ids(M.read_emails(spark, [str(path)], mode="DROPMALFORMED")).collect()] == ["1"]


def test_write_new_appends_once(spark, tmp_path):
    out = str(tmp_path / "mail")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "seq long, message_id string")
    none = spark.createDataFrame([("b",)], "message_id string")
    assert M.write_new(new, none, out) == {"exported": 2, "skipped": 1}
    stored = L.existing_ids(spark.read.schema("seq long, message_id string").json(out))
    assert M.write_new(new.filter("seq <> 2"), stored, out) == {"exported": 0, "skipped": 2}
    assert M.append_new(new, none, cap=2).count() == 1


def test_flatten_messages_parts_headers_and_bad_bytes(spark):
    def part(kind, data=None, parts=None):
        coded = None if data is None else base64.urlsafe_b64encode(data).decode().rstrip("=")
        return {"mimeType": kind, "body": {"data": coded}, **({"parts": parts} if parts else {})}

    def message(i, payload):
        return json.dumps({"id": i, "threadId": "t", "snippet": "a &amp; b", "payload": payload})

    nested = part("multipart/mixed", parts=[part("text/html", b"<b>no</b>"), part("multipart/alternative", parts=[
        part("text/plain", "é one".encode()), part("text/plain", b"two")])])
    nested["headers"] = [{"name": "SUBJECT", "value": "s"}, {"name": "Subject", "value": "later"}]
    html_only = part("multipart/mixed", parts=[part("text/html", b"<p>x</p> \xff\xfe y")])
    broken = part("text/plain")
    broken["body"]["data"] = "abcde"
    lines = [message("1", nested), message("2", html_only), message("3", broken)]
    raw = spark.read.schema(raw_message(3)).json(spark.sparkContext.parallelize(lines))
    got = {r["message_id"]: r for r in M.flatten_messages(raw, "acc", "Follow Up", depth=3).collect()}
    assert got["1"]["text"] == "é one two" and got["1"]["body_raw"] == "é one\ntwo" and got["1"]["subject"] == "s"
    assert got["2"]["text"] == "x �� y" and got["2"]["cc"] == ""
    assert got["3"]["text"] == "" and got["3"]["label"] == "follow_up" and got["3"]["snippet"] == "a & b"


def test_report_averages_and_zero_division(spark):
    rows = [("a", "a")] * 9 + [("a", "b")] + [("b", "b")] * 3 + [("b", "a")] * 2 + [("c", "a")]
    report = {r["label"]: r for r in C.classification_report(spark.createDataFrame(rows, "label string, prediction string")).collect()}
    assert report["c"]["f1"] == 0 and report["c"]["support"] == 1
    assert report["accuracy"]["precision"] == pytest.approx(12 / 16)
    assert report["macro avg"]["recall"] == pytest.approx((0.9 + 0.6 + 0) / 3)
    assert report["weighted avg"]["recall"] == pytest.approx(12 / 16)


def test_streams_do_not_repeat_rows(spark, tmp_path):
    from postsift.streaming import mail_stream as ST

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    mail = spark.createDataFrame([("a", "1", "1704067200000"), ("a", "2", "1704067260000"), ("a", "1", "1704067320000")],
                                 "account string, message_id string, internal_date string")
    mail.coalesce(1).write.parquet(source)
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def run():
        query = ST.append_unseen(ST.event_time(ST.read_stream(spark, source, mail.schema)), out, state)
        progress = [p for p in query.recentProgress if p["numInputRows"]]
        return spark.read.parquet(out).count(), progress

    assert run()[0] == 2
    assert run()[0] == 2 and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == store
    mail.coalesce(1).write.mode("append").parquet(source)
    assert run()[0] == 2
    # Mail from long ago is not too late, a key that comes again much later is still known, and mail without an id all passes.
    late = [("a", "3", "1600000000000"), ("a", "1", "1800000000000"), ("a", None, "1800000000000"), ("a", None, "1600000000000"),
            ("a", "", "1600000000000"), (None, "1", "1600000000000"), (None, "1", "1700000000000")]
    spark.createDataFrame(late, mail.schema).coalesce(1).write.mode("append").parquet(source)
    rows, progress = run()
    assert rows == 7
    # A batch reads what came and looks keys up in the state, whatever was stored before; it goes through the input twice.
    assert sum(p["numInputRows"] for p in progress) <= 2 * len(late)
    assert "RocksDB" in str(progress[-1]["stateOperators"][0]["customMetrics"]) or "rocksdb" in str(progress[-1]["stateOperators"][0]["customMetrics"])
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 4
    assert run()[0] == 7


def test_line_numbers_do_not_hang_on_splits_or_later_files(spark, tmp_path):
    folder, manifest = tmp_path / "in", str(tmp_path / "manifest")
    folder.mkdir()
    for name in ("b", "d"):
        lines = [json.dumps({"message_id": f"{name}{i}", **({"size": i, "tag": {"k": [1, "2"]}} if i % 2 else {})}) for i in range(900)]
        (folder / f"{name}.jsonl").write_text("\n\n".join(lines) + "\n", encoding="utf-8")
    (folder / "empty.jsonl").write_text("", encoding="utf-8")

    def read():
        return {r["message_id"]: (r["seq"], r["extra_fields"]) for r in M.read_emails(spark, [str(folder)], manifest=manifest).collect()}

    first = read()
    assert first["b0"] == (0, None) and first["b1"] == (2, '{"size":1,"tag":{"k":[1,"2"]}}') and first["b899"][0] == 2 * 899
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "4096")
        spark.conf.set(names[1], "512")
        assert read() == first
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    (folder / "a.jsonl").write_text('{"message_id":"new"}\n', encoding="utf-8")
    again = read()
    # The empty file has no number yet, and the new one comes third although its name is the first.
    assert again.pop("new")[0] >> M.LINE_BITS == 2 and again == first
    out = str(tmp_path / "out")
    M.write_jsonl(M.read_emails(spark, [str(folder)]).drop("seq"), out)
    assert {r["message_id"]: r["extra_fields"] for r in M.read_emails(spark, [out]).collect()}["d3"] == first["d3"][1]


def test_two_accounts_may_use_one_id(spark, tmp_path):
    keys, schema = ["account", "message_id"], "seq long, account string, message_id string"
    stored = spark.createDataFrame([(1, "a", "1"), (2, None, "2"), (3, "a", None)], schema)
    new = spark.createDataFrame([(4, "a", "1"), (5, "b", "1"), (6, None, "2"), (7, "b", None), (8, "a", "2")], schema)
    known = L.existing_ids(stored, keys)
    assert {r["seq"] for r in M.append_new(new, known, keys=keys).collect()} == {5, 7, 8}
    assert {r["seq"] for r in M.append_new(new, L.existing_ids(stored)).collect()} == {7}
    assert {r["seq"] for r in L.pending_records(new, stored, keys=keys).collect()} == {5, 7, 8}
    assert M.write_new(new, known, str(tmp_path / "mail"), keys=keys) == {"exported": 3, "skipped": 2}


def test_report_counts_labels_nobody_saw(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "a")], "label string, prediction string")
    labels = spark.createDataFrame([("a",), ("b",), ("b",)], "label string")
    report = {r["label"]: r for r in C.classification_report(rows, labels=labels).collect()}
    assert report["b"]["support"] == 0 and report["macro avg"]["f1"] == pytest.approx(0.5) and report["accuracy"]["f1"] == 1


def test_label_names_belong_to_an_account(spark):
    mail = spark.createDataFrame([(1, "x", ["L1", "INBOX"]), (2, "y", ["L1"]), (3, None, ["L1"])], "seq long, account string, label_ids array<string>")
    names = spark.createDataFrame([("x", "L1", "Bills"), ("y", "L1", "Fun")], "account string, label_id string, name string")
    got = {r["seq"]: r["gmail_label_names"] for r in M.map_label_names(mail, names).collect()}
    assert got == {1: ["Bills", "INBOX"], 2: ["Fun"], 3: ["L1"]}
    with pytest.raises(Exception, match="two names"):
        M.map_label_names(mail, names.union(spark.createDataFrame([("x", "L1", "Other")], names.schema))).collect()


def test_spam_and_trash_stay_out(spark):
    mail = spark.createDataFrame([(1, ["L1"]), (2, ["L1", "SPAM"]), (3, ["TRASH", "L1"]), (4, None)], "seq long, label_ids array<string>")
    resolved = spark.createDataFrame([("fyi", "L1")], "canonical string, label_id string")
    assert [r["seq"] for r in M.extract_by_label(mail, resolved).collect()] == [1]
    assert sorted(r["seq"] for r in M.extract_by_label(mail, resolved, 2, include_spam_trash=True).collect()) == [1, 2]


def test_parts_of_any_depth_are_found(spark):
    def message(depth):
        part = {"mimeType": "text/plain", "body": {"data": base64.urlsafe_b64encode(b"deep").decode()}}
        odd = [None, 7, "x", {"parts": 3, "body": [1]}] if depth > 6 else [None]  # above, parts are read with a schema
        first = {"mimeType": "text/plain", "body": {"data": base64.urlsafe_b64encode(b"first").decode()}}
        for level in range(depth):
            part = {"mimeType": "multipart/mixed", "parts": [first, *odd, part] if level == 0 else [part]}
        return json.dumps({"id": str(depth), "payload": {"mimeType": "multipart/mixed", "headers": [], "parts": [part]}})

    raw = spark.read.schema(raw_message(M.PART_DEPTH)).json(spark.sparkContext.parallelize([message(d) for d in (1, 4, 5, 6, 7, 9, 30)]))
    texts = {r["message_id"]: r["text"] for r in M.flatten_messages(raw, "a").collect()}
    assert texts == {str(d): "first deep" for d in (1, 4, 5, 6, 7, 9, 30)}


def test_only_notification_hosts_are_blocked(spark):
    senders = ["Ann <ann@googlemail.com>", "Bo <bo@docs.google.com>"]
    mail = spark.createDataFrame([(i, s, "me@x.org", "urgent") for i, s in enumerate(senders)], "seq long, `from` string, `to` string, label string")
    gated = C.draft_gate(mail, "me@x.org", spark.createDataFrame([], "email string")).orderBy("seq").collect()
    assert gated[0]["should_auto_draft"] and gated[1]["draft_block_reason"] == "automated_sender_domain:docs.google.com"


def test_balanced_class_weights(spark):
    from postsift.operators.models import class_weights

    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "label string")
    got = {r["label"]: r["class_weight"] for r in class_weights(df, ["a", "b"]).distinct().collect()}
    assert got == {"a": pytest.approx(8 / 12), "b": pytest.approx(2.0)}


def test_expansion_by_account(spark):
    """Two mailboxes use the id ``m1`` for different mail."""
    raw = spark.createDataFrame([(0, "a", "m1", "", "one"), (1, "b", "m1", "", "two"), (2, "a", "m1", "", "one again"), (3, "b", "m2", "", "x")],
                                "seq long, account string, message_id string, label string, text string")
    parts = spark.createDataFrame([(0, "m1", 0), (1, "m1", 1), (3, "m2", 1)], "seq long, message_id string, component long")
    groups = spark.createDataFrame([(0, "group_00002", 1, 0, "m1"), (1, "group_00001", 2, 1, "m1")],
                                   "component long, template_group_id string, group_size long, rep_seq long, representative_message_id string")
    marks = G.assignments(parts, groups, raw, ["account"])
    reps = spark.createDataFrame([(5, "group_00002", "payment", "", 0.9, "", "reviewed"), (6, "group_00001", "urgent", "", 0.9, "", "reviewed")],
                                 "seq long, template_group_id string, label string, openai_label string, openai_confidence double, "
                                 "openai_reason string, review_status string")
    rows = L.expand_labels(raw, marks, reps, keys=["account", "message_id"]).collect()
    assert sorted((r.account, r.message_id, r.label, r.text) for r in rows) == [
        ("a", "m1", "payment", "one again"), ("b", "m1", "urgent", "two"), ("b", "m2", "urgent", "x")]
    some = raw.filter("account = 'b'")
    missing = lambda keys: [r[0] for r in L.missing_groups(some, marks, reps.limit(0), keys).orderBy(
        "template_group_id").collect()]
    assert missing(["account", "message_id"]) == ["group_00001"] and missing(["message_id"]) == ["group_00001", "group_00002"]


def test_sender_report_equals_a_loop(spark):
    mail = [("Ann <ann@x.org>", "", "s0"), ("No-Reply <no-reply@shop.com>", "payment", "s1"), (None, "", "s2"), ("nobody", "urgent", None),
            ("Shop <no-reply@shop.com>", "payment", None), ("\"Shop\" <no-reply@shop.com>", "", "s5"), ("no-reply@shop.com", "", "s6")]
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(mail)], "seq long, `from` string, label string, subject string").repartition(3)
    report = S.mine_senders(df)
    assert report["totals"].first().asDict() == {"records": 7, "unique_senders": 2, "unique_domains": 2}
    row, = report["candidates"].collect()
    assert (row.email, row["count"], row.display_name, row.sample_subjects) == ("no-reply@shop.com", 4, "Shop", ["s1", "", "s5"])
    assert row.labels == '{"payment":2,"unknown":2}'
    assert [tuple(r) for r in report["top_domains"].collect()] == [("shop.com", 4), ("x.org", 1)]
    none = S.mine_senders(df.limit(0))
    assert none["totals"].first().asDict() == {"records": 0, "unique_senders": 0, "unique_domains": 0} and none["candidates"].count() == 0
