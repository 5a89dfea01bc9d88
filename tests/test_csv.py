import os
import tempfile

from segmenter.errors import DataQualityError
from segmenter.operators.columns import project_canonical, resolve_aliases
from segmenter.sources.csv_scan import check_usable, is_csv_name, null_tokens, read_csv_robust

DIRTY = ("id,amount,recency\n"
         "1,10,5\n"
         '2,"1,5",6\n'
         "3,4\n"
         "4,5,6,7\n"
         ",,\n"
         "\n"
         "  5, 7,8\n"
         "6,NA,9\n")


def write(text, name="dirty.csv", encoding="utf-8"):
    d = tempfile.mkdtemp(prefix="segmenter-csv-")
    with open(os.path.join(d, name), "w", encoding=encoding, newline="") as f:
        f.write(text)
    return d


def test_dirty_csv_accept_reject(spark):
    res = read_csv_robust(spark, write(DIRTY))
    acc = sorted(tuple(r) for r in res.accepted.collect())
    assert acc == [("1", "10", "5"), ("2", "1,5", "6"), ("5", "7", "8"), ("6", "NA", "9")]
    rej = sorted((r["line_no"], r["reason"]) for r in res.rejected.collect())
    assert rej == [(4, "field count"), (5, "field count"), (6, "empty row"), (7, "empty row")]
    # A one-column projection does not bring malformed rows back.
    assert sorted(r[0] for r in res.accepted.select("id").collect()) == ["1", "2", "5", "6"]
    assert [r["amount"] for r in null_tokens(res.accepted).where("id = '6'").collect()] == [None]


def test_windows_1251_russian_headers(spark):
    text = "Клиент,Сумма,Давность\n1,10,5\n2,20,6\n"
    res = read_csv_robust(spark, write(text, encoding="windows-1251"))
    assert res.header == ["Клиент", "Сумма", "Давность"]
    canon = project_canonical(res.accepted)
    assert canon.columns == ["client_id", "recency", "amount"]
    assert sorted(tuple(r) for r in canon.collect()) == [("1", "5", "10"), ("2", "6", "20")]


def test_guards(spark):
    res = read_csv_robust(spark, write("id,amount\n1,2\n"))
    try:
        check_usable(res)
        raise AssertionError("expected DataQualityError")
    except DataQualityError:
        pass
    assert is_csv_name("A.CSV") and not is_csv_name("a.txt")


def test_alias_first_match_wins():
    assert resolve_aliases([" Buyer ", "ID", "Total_Spent", "x"]) == {"client_id": " Buyer ", "amount": "Total_Spent"}


def test_every_file_has_its_own_header(spark):
    d = write("id,amount,recency\n1,10,5\n", "a.csv")
    for name, text in (("b.csv", "id,recency,amount\n3,30,7\n"), ("c.csv", "id,amount\n4,40\n4,40,5\n"), ("d.csv", "junk\n9\n")):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    res = read_csv_robust(spark, d)
    assert res.header == ["id", "amount", "recency"]
    assert sorted(tuple(r) for r in res.accepted.collect()) == [("1", "10", "5"), ("3", "7", "30"), ("4", "40", None)]
    assert sorted((os.path.basename(r["file"]), r["line_no"], r["reason"]) for r in res.rejected.collect()) == [
        ("c.csv", 3, "field count"), ("d.csv", 2, "bad header")]


def test_undecodable_bytes_are_replaced(spark):
    d = tempfile.mkdtemp(prefix="segmenter-csv-")
    with open(os.path.join(d, "x.csv"), "wb") as f:
        f.write("Клиент,Сумма\n".encode("windows-1251") + b"a\x98b,1\n" + b"c,2\n")
    res = read_csv_robust(spark, d)
    assert sorted(tuple(r) for r in res.accepted.collect()) == [("a\ufffdb", "1"), ("c", "2")]


def test_no_line_is_lost_when_splits_change(spark):
    d = write("id,amount\n" + "".join(f"{i},{i}\n" if i % 10 else f"{i}\n" for i in range(200_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
        res = read_csv_robust(spark, d)
        for size in ("256k", "100k", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert res.accepted.count() == 180_000
            lines = [r["line_no"] for r in res.rejected.select("line_no").collect()]
            assert sorted(lines) == [i + 2 for i in range(0, 200_000, 10)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
