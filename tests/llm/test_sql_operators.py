import duckdb

from lexloom.llm import chat_format, mixing, url_filters
from lexloom.llm.queries import op7_url_filters, op8_chat_format, op10_mixing


def sql(path, table, query, columns):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({query})").fetchall(), key=str)


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


URL = ["page_id", "host", "path", "rule", "verdict"]


def test_url_query(spark):
    d = "/root/testdata/sf0.01"
    got = rows(op7_url_filters(spark, d), URL)
    assert got == sql(f"{d}/pages.parquet", "pages", url_filters.oracle(), URL)
    assert len({r[3] for r in got}) == 6


def brute(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, default)))


def test_nested_rules(spark):
    rules = [("com", "", "allow"), ("a.com", "/x", "block"), ("b.a.com", "/", "allow"), ("a.com", "/x/y", "allow"), ("a.com", "/x/y/z", "block"), ("aa.com", "/", "block"), ("com", "/x/y/zz/longer/", "block"), ("a.com", "/x/y", "block"), ("", "/none", "block")]
    hosts = ["a.com", "b.a.com", "c.b.a.com", "A.com", "aa.com", "com", "xa.com", "com.a", "", "a.com:80"]
    paths = ["", "/", "/x", "/x/y/z/1", "/x/y?z", "/xx#y", "/x/y/zz/longer/q", "/none/1"]
    urls = [f"{s}{h}{p}" for s in ("http://", "https://") for h in hosts for p in paths] + [None, "", "no scheme", "://", "http://?q", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, url_filters.rules_table(spark, rules), "block").collect()}
    assert got == {i: brute(u, rules, "block") for i, u in enumerate(urls)}
    assert url_filters.judge(pages.limit(0), url_filters.rules_table(spark, rules)).collect() == []
    assert {r.verdict for r in url_filters.judge(pages, url_filters.rules_table(spark, rules).limit(0)).collect()} == {"allow"}


CHAT = ["conv_id", "n_turns", "n_copies", "chat"]


def test_chat_query(spark):
    d = "/root/testdata/sf0.01"
    got = rows(op8_chat_format(spark, d), CHAT)
    assert got == sql(f"{d}/conversations.parquet", "conversations", chat_format.oracle(), CHAT)


def test_snapshots(spark):
    talk = [("system", "be kind"), ("user", "hi"), ("assistant", "hello"), ("user", None), (None, "")]
    data = []
    for conv, upto in ((1, 2), (2, 4), (3, 5), (4, 5), (5, 1), (6, 3)):
        data += [(conv, t, *talk[t], "m") for t in range(upto)]
    data += [(7, 0, "system", "be kind", "m"), (7, 1, "user", "HI", "m"), (8, 0, "user", "hi", "m"), (8, 0, "user", "hi", "m"), (9, None, "user", "first", "m"), (9, 5, "user", "then", "m"), (None, 0, "user", "lost", "m")]
    data += [(10, i, "user", f"turn {i}", "m") for i in range(9000)] + [(11, i, "user", f"turn {i}", "m") for i in range(8000)]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, chat string")
    got = {r.conv_id: r for r in chat_format.render(turns).collect()}
    assert sorted(got) == [3, 7, 8, 9, 10] and got[3].n_copies == 2 and got[8].n_turns == 1 and got[10].n_turns == 9000
    assert got[3].chat == "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\n<|end|>\n<|unknown|>\n<|end|>\n"
    assert got[9].chat == "<|user|>\nfirst<|end|>\n<|user|>\nthen<|end|>\n"
    assert chat_format.render(turns.limit(0)).collect() == []


def test_nulls_count_as_what_they_are_rendered_as(spark, tmp_path):
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "hi"), (2, 1, "assistant", ""), (2, 2, "user", "go"), (3, 0, None, "x"), (4, 0, "unknown", "x"), (5, 0, None, None), (5, 0, "unknown", "")]
    path = str(tmp_path / "c.parquet")
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    got = rows(chat_format.render(spark.read.parquet(path)), CHAT)
    assert got == sql(f"{path}/*.parquet", "conversations", chat_format.oracle(), CHAT)
    assert [r[:3] for r in got] == [(2, 3, 1), (3, 1, 2), (5, 1, 1)]


def test_mixing_query(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    slots = mixing.target_slots(docs)
    got = op10_mixing(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    by = {}
    for r in got:
        assert r.release <= r.slot < r.deadline and 0 <= r.place < mixing.BLOCK
        by.setdefault(r.source, []).append((r.block, r.place))
        assert by[r.source] and r.slot % sum(slots.values()) < sum(slots.values())
    for s, places in by.items():  # blocks are filled in order, without gaps
        assert sorted(b * mixing.BLOCK + p for b, p in places) == list(range(len(places)))
    taken = {}
    for r in got:
        assert taken.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)


def test_mixing_edges(spark):
    rows = [(i, None if i % 3 == 0 else "a", "x") for i in range(100)] + [(None, "b", "y"), (5, "a", "x"), (5, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    got = mixing.mix(docs, mixing.target_slots(docs, {"a": 2.0, "": 1.0}), 4).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.source or "") for r in got) == sorted((i is None, i or 0, s or "") for i, s, _ in rows)
    assert len({(r.slot, r.place) for r in got}) == len(rows)
    assert mixing.mix(docs.limit(0), mixing.target_slots(docs.limit(0))).collect() == []
    assert mixing.in_order(docs, mixing.target_slots(docs)).columns == docs.columns
