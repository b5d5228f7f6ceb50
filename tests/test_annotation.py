"""Golden cases of extraction and search with hand-written spans."""

import random

import pandas as pd
from pyspark.sql import functions as F

from parley.functions import stemming as st
from parley.functions import text as tx
from parley.functions.text import strip_code_blocks
from parley.operators import annotate as a
from parley.operators import filters as f
from parley.operators import queries as q
from parley.operators import search as s
from parley.operators import windows as w


def word_spans(msg_idx, text, pos=None, **flags):
    """Spans of the words of ``text``; ``pos`` maps words to a part of speech."""
    out, at = [], 0
    for word in text.replace(",", " ,").replace(".", " .").split():
        start = text.index(word, at)
        at = start + len(word)
        out.append({"conv_id": "c", "msg_idx": msg_idx, "kind": "word", "start": start, "end": at, "text": word,
                    "pos": (pos or {}).get(word, "X"), "prob": 0.9 if word in (pos or {}) else None,
                    "negated": False, "stopword": word in flags.get("stop", ())})
    return out


def chunk(msg_idx, text, phrase, ner_type=None, tag=None, **more):
    start = text.index(phrase)
    return {"conv_id": "c", "msg_idx": msg_idx, "kind": "chunk", "start": start, "end": start + len(phrase),
            "text": phrase, "ner_type": ner_type, "ner_tag": tag or ner_type, **more}


def of_kind(table, kind):
    return table.filter(F.col("kind") == kind)


def texts(spark, *lines):
    return spark.createDataFrame([("c", i, line) for i, line in enumerate(lines)],
                                 "conv_id string, msg_idx int, text string")


def test_adjectives(spans):
    first = "Ich suche ein ruhiges und romantisches Restaurant in Berlin"
    second = "Ein nettes Restaurant für den kommenden Montag."
    table = spans(word_spans(0, first, {"ruhiges": "ADJA", "romantisches": "ADJA", "Restaurant": "NN"})
                  + word_spans(1, second, {"nettes": "ADJA", "kommenden": "ADJA"}))
    found = [r.value for r in f.adjective_tokens(table).orderBy("message_idx", "start").collect()]
    assert found == ["ruhiges", "romantisches", "nettes"]


def test_negation(spans):
    text = "Bitte kein chinesisches oder indisches Restaurant."
    table = spans(word_spans(0, text, {"chinesisches": "ADJA", "indisches": "ADJA"})
                  + [chunk(0, text, "kein chinesisches oder indisches Restaurant", negated=True)])
    marked = a.mark_negated(f.adjective_tokens(table), of_kind(table, "chunk")).collect()
    assert {r.value: r.hints for r in marked} == {"chinesisches": ["negated"], "indisches": ["negated"]}


def test_entities(spark, spans):
    text = "Brauche einen Zug von München nach Hamburg, aber bitte nicht über Nürnberg."
    places = ["München", "Hamburg", "Nürnberg"]
    table = spans(word_spans(0, text, {p: "NE" for p in places}) + [chunk(0, text, p, "location") for p in places]
                  + [chunk(0, text, "nicht über Nürnberg", negated=True)])
    chunks = of_kind(table, "chunk")
    entities = a.entities_with_content_word(a.entity_tokens(chunks, texts(spark, text)), of_kind(table, "word"))
    marked = a.mark_negated(entities, chunks).orderBy("start").collect()
    assert [(r.value, r.type, "negated" in r.hints) for r in marked] == [
        ("München", "Place", False), ("Hamburg", "Place", False), ("Nürnberg", "Place", True)]
    assert all(r.confidence == 0.8 and text[r.start:r.end] == r.value for r in marked)


def test_agent_messages_give_no_tokens(spark, messages, spans):
    lines = ["Brauche einen Zug nach Ilmenau.", "Von wo willst Du nach Ilmenau?", "Darmstadt."]
    msg = messages([("c", i, {"content": t, "origin": "Agent" if i == 1 else "User"}) for i, t in enumerate(lines)])
    rows = []
    for i, (line, place) in enumerate(zip(lines, ["Ilmenau", "Ilmenau", "Darmstadt"])):
        rows += word_spans(i, line, {place: "NE"}) + [chunk(i, line, place, "location")]
    stop = spark.createDataFrame([], "lang string, key string, variants array<string>")
    vocabulary = spark.createDataFrame([], "label string, surface string")
    tokens = a.analyze(msg, spans(rows), stop, vocabulary)
    assert [(r.message_idx, r.value) for r in tokens.orderBy("token_idx").collect()] == [(0, "Ilmenau"), (2, "Darmstadt")]


def test_fenced_code_gives_no_tokens_and_stages_fail_alone(spark, messages, spans):
    text = "Look at this\n```\nget http://code.example.org/x\n```\nand http://text.example.org/y please"
    msg = messages([("c", 0, {"content": text, "origin": "User"})])
    stop = spark.createDataFrame([], "lang string, key string, variants array<string>")
    vocabulary = spark.createDataFrame([("look", "Look")], "label string, surface string")
    words = a.message_words(msg.withColumn("content", strip_code_blocks(F.col("content"))))
    own = words.select("*", F.lit("word").alias("kind"), F.lit("NE").alias("pos"))
    shaped = spans([]).unionByName(own, allowMissingColumns=True)

    def broken(_msg, _spans):
        raise ValueError("no model")

    for problems in (None, []):
        found = a.analyze(msg, shaped, stop, vocabulary, problems=problems).collect()
        values = {r.value for r in found}
        assert "look" in values and any("text.example.org" in v for v in values)
        assert not any("code.example.org" in v for v in values) and not problems
    problems = []
    found = a.analyze(msg, shaped, stop, vocabulary.drop("surface"), problems=problems, extractors=[broken]).collect()
    assert sorted(name for name, _ in problems) == ["broken", "labels"]
    assert any("text.example.org" in r.value for r in found) and not any(r.value == "look" for r in found)
    raw = a.analyze(msg, shaped, stop, vocabulary, processors=()).collect()
    assert any("code.example.org" in r.value for r in raw)


def test_location_append(spark, spans):
    text = "Der Zug von München Hbf ist da"
    table = spans(word_spans(0, text) + [chunk(0, text, "München", "location"),
                                         chunk(0, text, "Hbf", "location", lemma="Hauptbahnhof")])
    merged = a.append_location_type(of_kind(table, "word"), of_kind(table, "chunk"), texts(spark, text)).collect()
    assert [(r.text, r.lemma, r.ner_type) for r in merged] == [("München Hbf", "München Hauptbahnhof", "location")]


def test_location_chains(spark, spans):
    """Pairs are taken from the left; an organization starts a pair but does not follow; a nested tail marks it."""
    text = "Aa Bb Cc und Dd Ee. Ff Gg"
    table = spans(word_spans(0, text) + [
        chunk(0, text, "Aa", "location", prob=0.5), chunk(0, text, "Bb", "location"), chunk(0, text, "Cc", "location"),
        chunk(0, text, "Dd", "location"), chunk(0, text, "Ee", "organization"),
        chunk(0, text, "Ff Gg", "organization"), chunk(0, text, "Gg", "location")])
    merged = a.append_location_type(of_kind(table, "word"), of_kind(table, "chunk"), texts(spark, text)).collect()
    assert sorted((r.text, r.prob) for r in merged) == [("Aa Bb", 1.0), ("Ff Gg", None)]


def test_adjective_location(spark, spans):
    text = "am Münchner Hauptbahnhof und alten Haus"
    table = spans(word_spans(0, text, {"Münchner": "ADJA", "alten": "ADJA"})
                  + [chunk(0, text, "Hauptbahnhof", "location", prob=0.5), chunk(0, text, "Haus", "misc")])
    found = a.adjective_locations(of_kind(table, "word"), of_kind(table, "chunk"), texts(spark, text)).collect()
    assert [(r.text, round(r.prob, 6)) for r in found] == [("Münchner Hauptbahnhof", round(1.4 / 1.45, 6))]


def test_keyword_phrase(spark, spans):
    text = "der neue Stand von Berlin ist gut"
    table = spans(word_spans(0, text, {"neue": "ADJA", "Stand": "NN", "von": "APPR", "Berlin": "NE", "gut": "ADJA"}))
    notes = spark.createDataFrame([("c", 0, 9, "one", 0.4), ("c", 0, 19, "one", 0.8), ("c", 0, 19, "two", 0.5)],
                                  "conv_id string, msg_idx int, start int, source string, prob double")
    ends = texts(spark, text).select("conv_id", "msg_idx", F.length("text").alias("end"))
    found = a.keyword_phrases(of_kind(table, "word"), ends, notes, texts(spark, text)).collect()
    assert [(r.value, round(r.confidence, 6)) for r in found] == [("neue Stand von Berlin", round(1.1 / 1.3, 6))]


def test_vocabulary(spark, messages):
    vocabulary = spark.createDataFrame(
        [("GeoSAP", "GeoSAP"), ("GeoSAP", "GIS"), ("Transaktion", "Transaktion"), ("Transaktion", "TAN"),
         ("Transaktion", "tCode")], "label string, surface string")
    words = a.message_words(messages([("c", 0, {"content": "Was ist der tCode für GIS? gis tan"})]))
    assert sorted(r.value for r in a.vocabulary_entities(words, vocabulary).collect()) == ["GeoSAP", "Transaktion"]


def test_long_labels(spark, messages):
    long = " ".join(f"w{chr(97 + i % 26)}" + chr(97 + i // 26 % 26) + chr(97 + i // 676) for i in range(2000))
    vocabulary = spark.createDataFrame(
        [("long", long), ("two", "sea side"), ("one", "sea"), ("three", "sea side town"), ("upper", "UN"), ("other", "Sea-Side")],
        "label string, surface string")
    words = a.message_words(messages([("c", 0, {"content": "Sea side TOWN, sea un UN sea side"}), ("c", 1, {"content": long}),
                                      ("c", 2, {"content": long.rsplit(" ", 1)[0]}), ("c", 3, {"content": "Side town"})]))
    found = sorted((r.message_idx, r.start, r.value) for r in a.vocabulary_entities(words, vocabulary).collect())
    assert found == sorted([(0, 0, "one"), (0, 0, "two"), (0, 0, "other"), (0, 0, "three"), (0, 15, "one"), (0, 22, "upper"),
                            (0, 25, "one"), (0, 25, "two"), (0, 25, "other"), (1, 0, "long")])
    assert a.vocabulary_entities(words, vocabulary.limit(0)).count() == 0


def test_trie(spark):
    entries = spark.createDataFrame([("a b c",), ("a b",), ("a d",), ("d",)], "_key string")
    edges = a.label_trie(entries).collect()
    assert sorted((e.word, e.more, e.ends) for e in edges) == [
        ("a", True, False), ("b", True, True), ("c", False, True), ("d", False, True), ("d", False, True)]
    assert {e.parent for e in edges if e.word == "a"} == {0}


def test_urls(spark):
    rows = [("http://foo.com/blah_blah/",), ("see https://www.example.com/foo/?bar=baz&inga=42&quux now",),
            ("khttp://foo.bar?q=Spaces should be encoded",), ("nothing",)]
    found = spark.createDataFrame(rows, "t string").select("t", tx.extract_urls(F.col("t")).alias("u")).collect()
    assert [len(r.u) for r in found] == [1, 1, 0, 0]
    assert all(r.t[u.start:u.end] == u.text for r in found for u in r.u)


def test_stop_words(spark):
    stop = spark.createDataFrame([(None, "hi", ["Hi"]), ("de", "us", ["US"])], "lang string, key string, "
                                                                               "variants array<string>")
    tokens = spark.createDataFrame([(v,) for v in ("hi", "HI", "Hi", "us", "US", "Us", "x")], "value string")
    assert sorted(r.value for r in a.remove_stopwords(tokens, stop, "de").collect()) == ["HI", "x"]


def test_latch_query(spark):
    tokens = spark.createDataFrame(
        [("c", 0, 0, "Peter Tester", "Person", 0.84794664), ("c", 1, 0, "München", "Place", 0.8487954),
         ("c", 2, 0, "Berlin", "Place", 0.84876066), ("c", 3, 0, "weak", "Place", 0.05)],
        "conv_id string, token_idx long, message_idx int, value string, type string, confidence double")
    built = q.latch_query(a.latch_slots(tokens), tokens, "", "", None).first()
    assert built.params == ['"München"^0.8487954', '"Berlin"^0.84876066', '"Peter\\ Tester"^0.84794664']
    assert q.web_query(a.latch_slots(tokens), tokens).first().query == "München Berlin Peter Tester"


def test_hint_rules(spark):
    text = "von Berlin nach Bonn, nicht nach Köln"
    places = [("Berlin", 4), ("Bonn", 16), ("Köln", 33)]
    tokens = spark.createDataFrame([("c", 0, at, at + len(p), p, "Place", [], 0.5) for p, at in places],
                                   "conv_id string, message_idx int, start int, end int, value string, type string, "
                                   "hints array<string>, confidence double")
    masked = a.type_masked_text(tokens, texts(spark, text))
    assert masked.first().masked == "von <Place> nach <Place>, nicht nach <Place>"
    rules = [("vo(?:n|m) (<Place>)", ["from"]), ("nach (<Place>)", ["to"]), ("nicht nach (<Place>)", ["not"])]
    assert [r.hints for r in a.apply_hint_rules(masked, rules).orderBy("start").collect()] == [["from"], ["to"], ["to"]]


def test_search(spark, messages):
    """Two conversations of the tenant match, the first with one run of two messages."""
    lines = {"c1": ("o", ["Das ist ein test", "Nochmal ein test", "Was anderes"]), "c2": ("o", ["Was anderes"]),
             "c3": ("o", ["test hallo"]), "c4": ("other", ["test hallo"])}
    msg = messages([(c, i, {"content": t}) for c, (_, ts) in lines.items() for i, t in enumerate(ts)])
    owners = spark.createDataFrame([(c, o) for c, (o, _) in lines.items()], "conv_id string, owner string")
    docs = w.merge_consecutive(msg).join(owners, "conv_id")
    assert docs.count() == 6
    terms = s.postings(docs, ["conv_id", "idx", "owner"])
    sized = docs.select(F.size(F.split("content", " ")).alias("len"))

    def found(text):
        queries = spark.createDataFrame([("q", "o", text)], "query_id string, owner string, text string")
        hits = s.group_hits(s.search(terms, sized, queries, ["conv_id", "idx"], ["owner"]), per_group=3)
        runs = w.hit_runs(s.hits_to_messages(hits, docs).select("query_id", "conv_id", "idx", "score"))
        return sorted((r.conv_id, r.start, r.end) for r in runs.collect())

    assert found("test") == [("c1", 0, 2), ("c3", 0, 1)]
    assert found("xyz") == []


def test_list_reading_equals_full_join(spark):
    """Frequent terms, copies and ties: reading lists in steps gives what joining everything gives."""
    import random

    rng = random.Random(7)
    tf, docs, queries = [], [], []
    for d in range(60):
        docs.append((d, "o", rng.randint(0, 2)))
        terms = {"a": 1, "b": 2} if d % 3 == 0 else {t: rng.randint(1, 3) for t in rng.sample("abcdefgh", 4)}
        tf += [(d, "o", t, n) for t, n in terms.items()]
        queries += [(d, "o", t, round(n / 3, 3)) for t, n in terms.items()]
    tf = spark.createDataFrame(tf, "conv_id long, owner string, term string, tf long")
    docs = spark.createDataFrame(docs, "conv_id long, owner string, votes long")
    queries = spark.createDataFrame(queries, "conv_id long, owner string, term string, boost double")
    stats = s.term_stats(tf, ["owner"])

    def run(**limits):
        found = s.related(queries, tf, docs, stats, F.lit(60), ["owner"], "conv_id", **limits)
        return sorted((r.query_id, r["rank"], r.conv_id, r.score, r.votes) for r in found.collect())

    scored = {}
    weights = {r.term: 1 + __import__("math").log(61 / (r.df + 1)) for r in stats.collect()}
    by_doc, votes = {}, {r.conv_id: r.votes for r in docs.collect()}
    for r in tf.collect():
        by_doc.setdefault(r.conv_id, {})[r.term] = r.tf * weights[r.term]
    for r in queries.collect():
        for d, terms in by_doc.items():
            if r.term in terms and d != r.conv_id:
                scored.setdefault(r.conv_id, {}).setdefault(d, 0.0)
                scored[r.conv_id][d] += r.boost * terms[r.term]
    want = []
    for query_id, found in scored.items():
        order = sorted(found, key=lambda d: (-round(found[d], 6), -votes[d], d))[:3]
        want += [(query_id, n, d, round(found[d], 6), votes[d]) for n, d in enumerate(order, 1)]
    assert run() == sorted(want)
    assert run(light_df=0, depth=1) == sorted(want)


def test_stemmers(spark):
    german = {"häuser": "haus", "aufeinanderfolgenden": "aufeinanderfolg", "kategorischen": "kategor",
              "möglichkeiten": "moglich", "laufen": "lauf", "bücher": "buch"}
    english = {"caresses": "caress", "ponies": "poni", "motoring": "motor", "relational": "relat", "hopping": "hop",
               "happy": "happi", "adjustment": "adjust", "controlling": "control", "electricity": "electr", "sky": "sky"}
    words = spark.createDataFrame([(w_,) for w_ in [*german, *english]], "t string")
    rows = words.select("t", st.snowball_de(F.col("t")).alias("de"), st.porter_en(F.col("t")).alias("en")).collect()
    assert {r.t: r.de for r in rows if r.t in german} == german
    assert {r.t: r.en for r in rows if r.t in english} == english


def test_search_word_query(spark):
    rows = spark.createDataFrame([("foo-bar 42 x?",), ("??",), (" ",)], "t string").select(
        tx.search_word_query(F.col("t")).alias("q")).collect()
    assert [r.q for r in rows] == ["foo\\-bar^4 foo\\-bar*^2 42^4 x\\?^4", "\\?\\?", None]


def test_code_blocks(spark):
    rows = [("before ```code``` after",), ("```code``` after",), ("open ```code",), ("a ```x``` ```y``` b",), ("none",)]
    got = [r.t for r in spark.createDataFrame(rows, "t string").select(
        tx.strip_code_blocks(F.col("t")).alias("t")).collect()]
    assert got == ["before.\n\nafter", "after", "open.", "a.\n\n\n\nb", "none"]


def test_search_word_query_like_its_clauses(spark):
    """All tokens of a text at once give what the clauses give one by one; nothing is done token by token."""
    rng = random.Random(5)
    signs = "abZ1 9\u0663é你\U0001d4b3\t\n\r\x0b\x0c  +-!():^[]\"{}~*?|&;/\\$_.,'’#\x00\x85\u2028\u3000%4"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    frame = spark.createDataFrame([(t,) for t in [*texts, "12", "a 12\x85 b\u2028", "a" * 50_000 + "! 1"]], "t string")
    clauses = F.transform(tx.search_word_terms(F.col("t")), lambda c: F.when(
        c["mode"] == "exact", F.concat(tx.escape_query(c["term"]), F.lit("^4"))).when(
        c["mode"] == "prefix", F.concat(tx.escape_query(c["term"]), F.lit("*^2"))).otherwise(
        F.concat(F.lit("*"), c["term"], F.lit("*"))))
    usual = ~tx.is_blank(F.col("t")) & tx.has_letter_or_digit(F.col("t"))
    found = frame.filter(usual).select(tx.search_word_query(F.col("t")).alias("q"), F.array_join(clauses, " ").alias("w"))
    assert found.filter("q <> w").count() == 0 and found.count() > 2000
    plan = frame.select(tx.search_word_query(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "lambda" not in plan


def test_stems_are_remembered_between_batches():
    st._porter_en.cache_clear()
    for _ in range(3):
        assert list(st.porter_en.func(pd.Series(["motoring", None, "motoring", "ties"]))) == ["motor", None, "motor", "ti"]
    assert st._porter_en.cache_info().misses == 2


def test_marks_are_stripped_once_for_each_variant(spark):
    texts = spark.createDataFrame([("(Die) Häuser, und;die;Bäume!",)], "t string")
    terms = st.analyze_text(texts, "t", "text_de", ["die", "und"])
    assert terms._jdf.queryExecution().analyzed().toString().count(tx.EDGE_PUNCTUATION) == 1
    assert "unddiebaum" in {r.term for r in terms.collect()}
