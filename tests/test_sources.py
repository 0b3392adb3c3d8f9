import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from mailscreen.operators import batch
from mailscreen.sources import labelled_csv, mail_files, uploads


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def csv_bytes(rows):
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    return out.getvalue()


def test_kaggle_shape(spark, tmp_path):
    rows = [["", "label", "text", "label_num"], ["5", " Spam", 'Subject: "win"\nnow, <b>free</b>', "1"], ["6", "ham", "NA", "0"], ["7", "ham", "ok", ""], ["8", "ham", "fine", "0"]]
    path = write(tmp_path / "k.csv", csv_bytes(rows))
    got = {r["email_id"]: (r["label"], r["label_name"], r["text"]) for r in labelled_csv.read_kaggle(spark, path).collect()}
    assert got == {"5": (1, "spam", 'Subject: "win" now, free'), "8": (0, "ham", "fine")}


def test_kaggle_without_number(spark):
    raw = spark.createDataFrame([("1", "SPAM ", "a"), ("2", "ham", "b"), ("3", "?", "c")], "row string, label string, text string")
    assert {(r["email_id"], r["label"]) for r in labelled_csv.kaggle_corpus(raw).collect()} == {("1", 1), ("2", 0)}


def test_enron_shape(spark, tmp_path):
    rows = [list(labelled_csv.ENRON_COLUMNS), ["1", "body", "0", "Ham", " subj ", "m", "d"], ["2", "", "1", "spam", "only subject", "", ""], ["3", "", "1", "spam", "", "", ""]]
    path = write(tmp_path / "e.csv", csv_bytes(rows))
    got = {r["email_id"]: (r["label_name"], r["text"]) for r in labelled_csv.read_enron(spark, path).collect()}
    assert got == {"1": ("ham", "subj body"), "2": ("spam", "only subject")}


def test_raw_labels(spark):
    enron = spark.createDataFrame([("1", "x", "1"), ("2", "y", "7"), ("3", "z", "no"), ("4", "  ", "0")], "message_id string, text string, label string")
    got = {(r["label"], r["label_name"]) for r in labelled_csv.raw_corpus([labelled_csv.raw_enron(enron)]).collect()}
    assert got == {(1, "spam"), (7, "ham")}


PLAIN = b"Subject: Hello =?utf-8?q?caf=C3=A9?=\nContent-Type: text/plain; charset=utf-8\n\nVisit http://x.y now \xc3\xa9\n"
MULTI = (
    b'Subject: Two\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary="B"\n\n--B\nContent-Type: text/plain\n\nplain part\n'
    b"--B\nContent-Type: text/html\n\n<p>html <script>x</script>part</p>\n--B\nContent-Type: image/png\n\nzzz\n--B--\n"
)
BINARY = b"Subject: pic\nContent-Type: application/octet-stream\nContent-Transfer-Encoding: base64\n\nAAAA\n"
ODD_CHARSET = b"Subject: s\nContent-Type: text/plain; charset=no-such\n\nbody\n"


def test_mail_folder(spark, tmp_path):
    folder = tmp_path / "easy"
    folder.mkdir()
    for name, data in {"a": PLAIN, "b": MULTI, "c": BINARY, "d": ODD_CHARSET, "e": b"", "f": b"\n\n  \n"}.items():
        write(folder / name, data)
    rows = mail_files.read_ham_folders(spark, {"easy_ham": str(folder), "hard_ham": str(tmp_path / "none")}).collect()
    got = {r["email_id"]: r["text"] for r in rows}
    assert got == {"a": "Hello café Visit URLTOKEN now é", "b": "Two plain part html part"}
    assert {(r["source"], r["label"], r["label_name"]) for r in rows} == {("spamassassin_easy_ham", 0, "ham")}
    messages = mail_files.parse_messages(mail_files.read_mail_folder(spark, str(folder)))
    assert mail_files.unreadable_count(messages).first()[0] == 2
    assert mail_files.read_ham_folders(spark, {"none": str(tmp_path / "none")}) is None


CONTENTS = [
    b"plain", "žluť".encode(), b"\xef\xbb\xbfwith mark", "caf\xe9".encode("latin-1"), bytes([0x81, 0x8D]) + b" latin only text here", b"", b"a\x00b",
    b"bell \x07", b"\xd2\xd2", b"tab\tnew\nline\r\n", b"\x80\x8e", "ệ tiếng".encode("cp1258", "ignore"), bytes(range(0x80, 0xA0)), b"\x1c", b"\xff\xfe\xfd" * 9,
]


def by_hand(content):
    if not content:
        return None, "empty_file"
    if b"\x00" in content:
        return None, "decode_error"
    for encoding in ("utf-8-sig", "utf-8", "cp1258", "latin-1"):
        try:
            text = content.decode(encoding)
        except UnicodeDecodeError:
            continue
        sample = text[:4096]
        odd = [c for c in sample if ord(c) < 32 and c not in "\n\r\t"]
        good = [c for c in sample if c.isprintable() or c in "\n\r\t"]
        if sample and not odd and len(good) / len(sample) >= 0.85:
            return text, None
    return None, "decode_error"


def test_decoding_follows_python(spark):
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(CONTENTS)], "i int, content binary")
    got = {r["i"]: (r["text"], r["error_code"]) for r in uploads.with_decoded(df).collect()}
    assert got == {i: by_hand(c) for i, c in enumerate(CONTENTS)}


LINES = "one\r\ntwo\n\n  \nthr\x0bee\x1cfour\x85five six\rseven\n\r\nlast\r"


def numbered(text):
    return {(i, " ".join(line.split())) for i, line in enumerate(text.splitlines(), 1) if line.strip()}


def test_lines_of_a_text(texts):
    got = {(r["row_number"], r["text"]) for r in uploads.text_lines(texts([LINES]), "text", ["id"]).collect()}
    assert got == numbered(LINES)


def test_line_files_read_in_small_splits(spark, tmp_path):
    big = "".join(f"line {i}{'  x' * (i % 9)}\n" + ("\n" if i % 7 == 0 else "") + ("a\x0bb\n" if i % 5 == 0 else "") for i in range(4000))
    write(tmp_path / "big.txt", big)
    write(tmp_path / "small.txt", LINES)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = uploads.read_line_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, text in (("big", big), ("small", LINES)):
        assert {(r["row_number"], r["text"]) for r in rows if r["file"].endswith(f"/{name}.txt")} == numbered(text)


@pytest.mark.parametrize(
    "data, want",
    [
        ("id,E-Mail,x\n1,\"hi, \"\"you\"\"\nthere\",b\n2,,c\n3\n4,yo\n", {(2, 'hi, "you" there'), (4, "3"), (5, "yo")}),
        ("subject,Body!,Text\ns,b,t\n", {(2, "t")}),
        ("just,cells\n,second\n  ,\n", {(1, "just"), (2, "second")}),
        ("message\n\"\"\n", {(1, "message")}),
    ],
)
def test_csv_batch(spark, tmp_path, data, want):
    path = write(tmp_path / "b.csv", data)
    assert {(r["row_number"], r["text"]) for r in uploads.read_csv_batch(spark, path).collect()} == want


def test_csv_options(spark, tmp_path):
    path = write(tmp_path / "c.csv", "a;b\n1;2\n")
    assert {r["text"] for r in uploads.read_csv_batch(spark, path, header=True, delimiter=";").collect()} == {"1"}
    assert {r["text"] for r in uploads.read_csv_batch(spark, path, header=False, delimiter=";").collect()} == {"a", "1"}


def test_text_column_choice(spark):
    rows = [(["ID", "Body", "e-mail"],), (["x", "y"],), (["a", "CONTENT "],), (["a", None],)]
    df = spark.createDataFrame(rows, "cells array<string>")
    assert [r[0] for r in df.select(uploads.header_choice(F.col("cells"))).collect()] == [2, None, 1, None]


def test_csv_layout_is_found_per_file(spark, tmp_path):
    write(tmp_path / "a.csv", "id,text\n1,first\n2,second\n")
    write(tmp_path / "b.csv", "text,id\nthird,3\n")
    write(tmp_path / "c.csv", "no header here\nfourth\n")
    write(tmp_path / "d.csv", "text\n")
    rows = {(r["file"][-5], r["row_number"], r["text"]) for r in uploads.read_csv_batch(spark, str(tmp_path)).collect()}
    assert rows == {("a", 2, "first"), ("a", 3, "second"), ("b", 2, "third"), ("c", 1, "no header here"), ("c", 2, "fourth"), ("d", 1, "text")}


def test_json_batch(spark, tmp_path):
    write(tmp_path / "a.json", json.dumps({"emails": ["x", None, " "], "messages": ["no"]}, indent=1))
    write(tmp_path / "b.json", json.dumps({"texts": None, "emails": ["no"]}))
    write(tmp_path / "c.json", json.dumps({"messages": ["m", 5]}))
    rows = uploads.read_json_batch(spark, str(tmp_path)).collect()
    assert sorted((r["file"][-6], r["row_number"], r["text"]) for r in rows) == [("a", 1, "x"), ("a", 2, ""), ("a", 3, " "), ("c", 1, "m"), ("c", 2, "5")]


def test_batch_checks(texts):
    checked = batch.check_texts(texts(["  a  b ", "", "x" * 11]), max_length=10)
    assert batch.batch_status(checked).first().asDict() == {"rows": 3, "accepted": 1, "blank": 1, "too_large": 1, "code": "text_too_large"}
    assert [r["text"] for r in batch.validate(checked).collect()] == ["a b"]
    assert [r["id"] for r in batch.rejected(checked).collect()] == [2]
    for values, code in ((["x" * 11], "text_too_large"), ([" "], "empty_batch"), (["a", "b", "c"], "batch_too_large")):
        with pytest.raises(batch.BatchRejected) as info:
            batch.validate(batch.check_texts(texts(values), max_length=10), "strict", max_rows=2)
        assert info.value.code == code
    assert batch.validate(batch.check_texts(texts(["a"])), "strict").count() == 1


def test_columns_go_by_name_and_labels_may_be_floats(spark, tmp_path):
    path = str(tmp_path / "k.csv")
    write(tmp_path / "k.csv", b"text,label_num,label\nhello there,1.0,spam\nhi,0.0,ham\nodd,0.5,ham\n")
    rows = {(r["text"], r["label"], r["email_id"]) for r in labelled_csv.read_kaggle(spark, path).collect()}
    assert rows == {("hello there", 1, ""), ("hi", 0, "")}
    write(tmp_path / "e.csv", b"label,text,message_id\n1.0,body,m1\n 0 ,other,m2\n")
    rows = {(r["text"], r["label"], r["email_id"]) for r in labelled_csv.read_enron(spark, str(tmp_path / "e.csv")).collect()}
    assert rows == {("body", 1, "m1"), ("other", 0, "m2")}
    write(tmp_path / "x.csv", b"text,message_id\nbody,m1\n")
    with pytest.raises(ValueError, match="label"):
        labelled_csv.read_enron(spark, str(tmp_path / "x.csv"))


def test_long_quoted_cells_in_short_rows(spark, tmp_path):
    long = "word " * 40_000
    (tmp_path / "a.csv").write_text('id,text,x\n1,"' + long + 'with ""quotes"", and, commas",y\n')
    (tmp_path / "b.csv").write_text('"' + long + '"\n\nplain,other\n')
    got = [(r["file"][-5:], r["row_number"], len(r["text"])) for r in uploads.read_csv_batch(spark, str(tmp_path)).orderBy("file", "row_number").collect()]
    assert got == [("a.csv", 2, len(long) + len('with "quotes", and, commas')), ("b.csv", 1, len(long.strip())), ("b.csv", got[2][1], 5)]


def test_line_files_follow_the_partitions(spark, tmp_path):
    """A fixed number of files would have each task write and read a fixed share of any table."""
    from mailscreen.registry.intake_queries import write_line_files

    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("line "), "id").alias("text"))
    changed = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        write_line_files(rows, str(tmp_path / "lines"))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    files = list((tmp_path / "lines").glob("part-*"))
    assert len(files) == 9 and sum(len(f.read_text().splitlines()) for f in files) == 500
