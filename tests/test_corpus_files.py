"""Readers and sinks over files, and streams against their batch results."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text
from lexloom.operators import lattice, learn, lexicon
from lexloom.sources import derived, readers, sinks
from lexloom.streaming import jobs


def write(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_tokens(spark, tmp_path):
    p = write(tmp_path / "a.txt", "\n\none\r\ntwo\r\n\r\n\n\nthree\n\nfour\nfive")
    got = [(r.block, r.tok_no, r.form) for r in readers.read_tokens(spark, p).orderBy("block", "tok_no").collect()]
    assert got == [(1, 1, "one"), (1, 2, "two"), (2, 1, "three"), (3, 1, "four"), (3, 2, "five")]
    assert readers.read_tokens(spark, p, limit=1).count() == 2
    assert readers.read_tokens(spark, p, strict_terminated=True).agg(F.max("block")).first()[0] == 2


def test_block_order_over_splits(spark, tmp_path):
    p = write(tmp_path / "many.txt", "".join(f"w{i}\nx\n\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [r.form for r in readers.read_tokens(spark, p).filter("tok_no = 1").orderBy("block").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [f"w{i}" for i in range(3000)]


CONLL = (
    "1\tseven\t_\tQTY\tQTY\tgen=F|num=P\t2\tamount\t_\t_\n# note\n2\tonce\t_\tADVT\tADVT\t_\t0\ttop\t_\t_\n3\thouse\t_\tNOUN\tNOUN_OWN\tnum=D|suf_gen=F|suf_gen=M|suf_per=2\t2\targ\t_\t_\nbad row\n\n"
    "1\tx\ty\tA\tB\t_\t0\tr\t_\t_\n"
)


def test_conll(spark, tmp_path):
    rows = readers.read_conll(spark, write(tmp_path / "a.conll", CONLL))
    good = {(r.block, r.id): r for r in rows.filter("_corrupt is null").collect()}
    assert good[1, 1].feats == {"gen": "F", "num": "P"} and good[1, 2].feats == {}
    assert good[1, 3].feats["suf_gen"] == "F,M" and good[1, 3].lemma == "" and good[2, 1].head == 0
    assert [r._corrupt for r in rows.filter("_corrupt is not null").collect()] == ["bad row"]
    out = str(tmp_path / "out")
    sinks.write_blocks(sinks.conll_lines(rows.filter("_corrupt is null"), ["path", "block"]), out, ["path", "block"])
    again = readers.read_conll(spark, out)
    key = lambda df: sorted((r.id, r.form, r.feat_str, r.head, r.deprel) for r in df.filter("_corrupt is null").collect())
    assert key(again) == key(rows)


def test_conllu(spark, tmp_path):
    content = "# sent 1\n1-2\tabc\t_\t_\t_\t_\t_\t_\t_\t_\n1\ta\tA\tX\tx\tk=v\t2\tr\t_\t_\n2\tbc\t_\tY\ty\t_\t0\troot\t1:a|2:b\t_\n2.1\tnull\t_\t_\t_\t_\t_\t_\t_\t_\n3\td\td\tZ\tz\t_\t2\tp\t_\tmisc\n\n"
    p = write(tmp_path / "a.conllu", content)
    rows = readers.read_conllu(spark, p).orderBy("id").collect()
    assert [(r.id, r.form, r.tok_no, r.token) for r in rows] == [(1, "a", 1, "abc"), (2, "bc", 1, "abc"), (3, "d", 2, "d")]
    assert rows[1].deps == ["1:a", "2:b"] and readers.sentence_comments(spark, p).first().comments == ["# sent 1"]
    line = sinks.conllu_lines(readers.read_conllu(spark, p), ["block"]).first().value.split("\n")
    assert line[0].startswith("1-2\tabc") and len(line) == 4 and line[2].split("\t")[2] == "bc"


def test_lattices(spark, tmp_path):
    p = write(tmp_path / "a.lat", "0\t1\tseven\t_\tQTY\tQTY\tgen=F|num=P\t1\n4\t4\tLagoon\t_\tPLACE\tPLACE\tbare\t4\n\n")
    rows = readers.read_lattice(spark, p).orderBy("from_node").collect()
    assert rows[0].feats == {"gen": "F", "num": "P"} and rows[1].to_node == 5 and rows[1].feats == {"bare": "bare"}
    back = sinks.lattice_lines(readers.read_lattice(spark, p), ["block"]).first().value
    assert back.startswith("0\t1\tseven\t_\tQTY\tQTY\tgen=F|num=P\t1\n4\t5")
    u = write(tmp_path / "u.lat", "# ab c\n0\t1\ta\t_\tX\tX\t_\t_\t1\n1\t2\tb\t_\tX\tX\t_\t_\t1\n2\t3\tc\t_\tX\tX\t_\t_\t2\n\n")
    assert [r.token for r in readers.read_lattice(spark, u, "ud").orderBy("from_node").collect()] == ["ab", "ab", "c"]
    s = write(tmp_path / "s.lat", "0-2\tab\n0\t1\ta\t_\tX\tX\t_\t_\n1\t2\tb\t_\tX\tX\t_\t_\n2-3\tc\n2\t3\tc\t_\tX\tX\t_\t_\n\n")
    assert [(r.tok_no, r.token) for r in readers.read_lattice(spark, s, "ul").orderBy("from_node").collect()] == [(1, "ab"), (1, "ab"), (2, "c")]
    edges = readers.read_lattice(spark, s, "ul").withColumn("oov", F.lit(True))
    assert sinks.ud_lattice_lines(edges, ["block"]).first().value.split("\n")[0] == "0-2\tab\t_\t_\t_\t_\t_\t_\toov=1"


def test_spans_by_sweep(spark, tmp_path):
    edge = "{}\t{}\t{}\t_\tX\tX\t_\t_\n"
    s = write(tmp_path / "s.lat", "2-3\tc\n" + edge.format(2, 3, "c") + "0-2\tab\n" + edge.format(1, 2, "b") + edge.format(0, 2, "ab") + edge.format(0, 1, "a") + edge.format(1, 3, "over") + edge.format(5, 6, "past") + "\n")
    assert sorted((r.form, r.tok_no, r.token) for r in readers.read_lattice(spark, s, "ul").collect()) == [("a", 1, "ab"), ("ab", 1, "ab"), ("b", 1, "ab"), ("c", 2, "c")]
    bare = write(tmp_path / "b.lat", edge.format(0, 1, "a") + edge.format(0, 2, "ab") + edge.format(1, 2, "b") + edge.format(2, 3, "c") + "\n")
    assert sorted((r.form, r.tok_no, r.token) for r in readers.read_lattice(spark, bare, "ul").collect()) == [("a", 1, None), ("ab", 1, None), ("b", 1, None), ("c", 2, None)]


def test_token_lattices(spark):
    toks = spark.createDataFrame([(1, 1, "bhouse"), (1, 2, "x"), (1, 3, "bhouse")], "sent int, tok_no int, form string")
    read = spark.createDataFrame([("bhouse", "b", "house", "NN", "g", False), ("bhouse", "b", "house", "VB", "", False), ("bhouse", "", "bhouse", "NNP", "", False), ("x", "", "x", "NN", "", True)], "form string, prefix string, host string, cpos string, feat_str string, oov boolean")
    got = sorted((r.from_node, r.to_node, r.form, r.cpos, r.feat_str, r.oov) for r in lexicon.token_lattices(toks, lexicon.split_morphs(read), ["sent"]).collect())
    word = lambda at: [(at, at + 1, "b", "PREFIX", "", False), (at, at + 2, "bhouse", "NNP", "", False), (at + 1, at + 2, "house", "NN", "g", False), (at + 1, at + 2, "house", "VB", "", False)]
    assert got == sorted([*word(0), (2, 3, "x", "NN", "", True), *word(3)])


def test_joint_attaches_what_it_chose(spark):
    rows = [(1, 1, 0, "X", 0, [("ab", "X")]), (1, 1, 1, "P;N", 1, [("a", "P"), ("b", "N")]), (1, 2, 0, "V", 0, [("c", "V")])]
    c = spark.createDataFrame(rows, "sent int, tok_no int, path_id int, key string, score long, morphs array<struct<form: string, cpos: string>>")
    pair = spark.createDataFrame([("P;N", "V", 3)], "key string, next_key string, w long")
    weights = spark.createDataFrame([("pp|P|N", 5), ("pp|N|V", 4), ("pp|V|ROOT", 6), ("rl|P|N|case", 1), ("rl|N|V|obj", 2), ("rl|V|ROOT|root", 1)], "feature string, w long")
    got = sorted((r.id, r.tok_no, r.form, r.head, r.deprel, r.score) for r in learn.joint(c, ["sent"], pair, weights).collect())
    assert got == [(1, 1, "a", 2, "case", 6), (2, 1, "b", 3, "obj", 6), (3, 2, "c", 0, "root", 7)]


def test_lexicons(spark, tmp_path):
    p = write(tmp_path / "lex", "word :NN-M-S:S-M-S-3 lemma :UNK: other\nword :VB-F-S-PAST: lem2\n\n")
    rows = readers.read_lexicon(spark, p).orderBy("tag").collect()
    assert [(r.tag, r.feat_str, r.lemma) for r in rows] == [("NN", "gen=M|num=S", "lemma"), ("VB", "gen=F|num=S|tense=PAST", "lem2")]
    assert rows[0].suffix.bridge == "של"
    ud = readers.read_lexicon(spark, p, "universal").orderBy("tag").collect()
    assert [(r.tag, r.feat_str) for r in ud] == [("NOUN", "Gender=Masc|Number=Sing"), ("VERB", "Gender=Fem|Number=Sing|Tense=Past")]
    q = write(tmp_path / "pre", "ב ב PREPOSITION:: ב^ה PREPOSITION+DEF::\n")
    got = readers.read_prefixes(spark, q).orderBy("analysis_id").collect()
    assert [[(m.form, m.cpos) for m in r.morphs] for r in got] == [[("ב", "PREPOSITION")], [("ב", "PREPOSITION"), ("ה", "DEF")]]
    u = write(tmp_path / "ud", "abc\ta\tA\tX\tx\t_\n\tbc\tB\tY\ty\t_\nabc\tabc\tC\tZ\tz\tk=v\n")
    assert [len(r.morphs) for r in readers.read_ud_lexicon(spark, u).orderBy("analysis_id").collect()] == [2, 1]
    c = write(tmp_path / "list", "# c\n\n a \nb\n")
    assert sorted(r.value for r in readers.read_list(spark, c).collect()) == ["a", "b"]
    assert readers.provenance(spark, c).first().md5 == hashlib.md5(b"# c\n\n a \nb\n").hexdigest()
    d = write(tmp_path / "dep", CONLL)
    assert readers.read_dep(spark, d).filter("form = 'once'").first().head == -1


def test_text_functions(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    assert pick(text.from_latin(F.lit("FLWM"))) == "שלום" and pick(text.to_latin(F.lit("שלום!"))) == "FLWM" and pick(text.from_latin(F.lit("yyDOT"))) == "."
    assert pick(text.parse_feats(F.lit("a==|b"), "lattice")) == {"a": "=", "b": "b"} and pick(text.parse_feats(F.lit("a"))) is None
    assert pick(text.union_feats(text.parse_feats(F.lit("g=F|n=1")), text.parse_feats(F.lit("g=M")))) == {"g": "F,M", "n": "1"}
    assert pick(text.universal_feats(F.lit("type=REF|binyan=HITPAEL|gen=F"))) == "Gender=Fem|PronType=Prs|Reflex=Yes"


def test_paths_of_a_dag(spark):
    rows = [(1, a, b) for a, b in ((1, 2), (1, 3), (2, 4), (4, 5), (4, 6), (5, 6), (3, 6), (1, 6))]
    e = spark.createDataFrame(rows, "tok_no int, from_node int, to_node int").withColumns({"form": F.concat_ws("-", "from_node", "to_node"), "cpos": F.lit("X")})
    got = {"".join(f"{m.from_node}" for m in r.morphs) + "6" for r in lattice.paths(e, ["tok_no"]).collect()}
    assert got == {"16", "136", "1246", "12456"}
    assert lattice.paths(e, ["tok_no"], max_paths=2).filter("truncated").count() == 2


def test_training_separates_a_toy_set(spark, tmp_path):
    rows = [(i, c, (i % 3) == c, f) for i in range(12) for c in range(3) for f in (f"w{i % 3}|{c}", f"bias|{c}")]
    features = spark.createDataFrame(rows, "item int, candidate int, gold boolean, feature string")
    n = [0]

    def save(df):
        n[0] += 1
        df.write.parquet(str(tmp_path / f"w{n[0]}"))
        return spark.read.parquet(str(tmp_path / f"w{n[0]}"))

    weights, history = learn.train(features, ["item"], 6, save)
    assert history[-1]["right"] == history[-1]["n"] == 12 and weights.count() > 0
    assert learn.should_stop([{"right": 5, "n": 10}, {"right": 4, "n": 10}]) and not learn.should_stop([{"right": 5, "n": 10}])


def test_best_sequence(spark):
    c = spark.createDataFrame([(1, 1, 0, "a", 5), (1, 1, 1, "b", 4), (1, 2, 0, "c", 1), (1, 2, 1, "d", 0), (2, 1, 0, "a", 0), (2, 1, 1, "a", 0)], "sent int, tok_no int, path_id int, key string, score long")
    pair = spark.createDataFrame([("b", "d", 10), ("a", "c", 1)], "key string, next_key string, w long")
    got = sorted((r.sent, r.tok_no, r.path_id) for r in learn.disambiguate(c, ["sent"], pair).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 0)]


def test_streams_match_batches(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    source = str(tmp_path / "in")
    docs.repartition(3).write.parquet(source)
    toks = derived.morphs(docs)
    dic = lexicon.learn_dictionary(toks.filter("doc_id % 10 <> 0"))
    stats = jobs.stream_stats(jobs.stream_documents(spark, source), dic, ["lang"])
    q = stats.writeStream.outputMode("complete").format("memory").queryName("stats").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    got = sorted((r.lang, r.n_tokens, r.n_oov) for r in spark.table("stats").collect())
    want = sorted((r.lang, r.n_tokens, r.n_oov) for r in lexicon.analysis_stats(toks, dic, ["lang"]).collect())
    assert got == want
    out = str(tmp_path / "out")
    q = jobs.stream_score(jobs.stream_analyze(jobs.stream_documents(spark, source), dic.select("form", "cpos").distinct()), lambda b: b.groupBy("doc_id").count(), out, str(tmp_path / "c2"))
    q.awaitTermination()
    assert spark.read.parquet(out).agg(F.sum("count")).first()[0] >= toks.count()
    p = tmp_path / "raw"
    p.mkdir()
    write(p / "x.txt", "a\nb\n\nc\n")
    q = jobs.stream_tokens(spark, str(p)).writeStream.format("memory").queryName("toks").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination()
    assert sorted(r.form for r in spark.table("toks").collect()) == ["a", "b", "c"]
    cand = toks.filter("doc_id < 3").select("doc_id", "line_no", "tok_no", F.col("form").alias("key"))
    fused = jobs.stream_fuse(cand, cand, ["doc_id", "line_no", "tok_no"])
    assert fused.filter("not is_gold").count() == 0


@pytest.mark.parametrize("name", ["Form", "Funcs_Main_POS", "Funcs_Main_POS_Both_Prop_Clitic"])
def test_projections(spark, name):
    m = spark.createDataFrame([(("ab_", "l", "NN", "NN", "g=1"),), (("h", "l", "DEF", "DEF", "_"),)], "m struct<form: string, lemma: string, cpos: string, pos: string, feat_str: string>")
    got = [r.x for r in m.select(text.projection(name, "m").alias("x")).collect()]
    assert got == {"Form": ["ab_", "h"], "Funcs_Main_POS": ["NN", "h_DEF"], "Funcs_Main_POS_Both_Prop_Clitic": ["s_NN_g=1", "h_DEF__"]}[name]
    text.register_projection("Twice", lambda m, o: F.concat(m["form"], m["form"]))
    assert m.select(text.project_path("Twice", F.array("m")).alias("x")).first().x == "ab_ab_"
