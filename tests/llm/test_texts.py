"""Line dedup, chat, packing, decontamination, pages and archives: small cases, round trips, damage."""
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import edits
from pyspark.sql import functions as F

from evalspark.llm import chat, decontaminate, html_text, line_dedup, packing, tokens, warc
from evalspark.llm.queries import vocabulary_path

DOCS = "doc_id bigint, text string"


def kept_lines(spark, rows, **options):
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS pos", "2 AS h", "3 AS drops")
    done = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df, **options))
    return [(r["doc_id"], r["_n_lines"], r["_n_dropped"], r["_kept_text"]) for r in done.collect()]




def test_lines(spark):
    rows = [(i, f"head {i}\n Shared LINE\t\n\n tail {i % 3}") for i in range(12)] + [(20, None), (21, ""), (22, "shared line\nshared line"), (22, "shared line\nshared line"), (None, "SHARED LINE\nown")]
    got = kept_lines(spark, rows)
    assert len(got) == len(rows)
    by = dict(((g[0], g[3]), g) for g in got)
    assert (3, 4, 1, "head 3\n\n tail 0") in got
    assert (20, 1, 0, "") in got and (21, 1, 0, "") in got
    assert got.count((22, 2, 2, "")) == 2 and (None, 2, 1, "own") in got and by
    assert kept_lines(spark, [])  == []


def test_first_occurrence_stays(spark):
    got = kept_lines(spark, [(1, "a\nb\na"), (2, "b\nA\nc"), (3, "c")], min_docs=1, keep_first=True)
    assert sorted(got) == [(1, 3, 1, "a\nb"), (2, 3, 2, "c"), (3, 1, 1, "")]


def test_many_lines_and_runs(spark):
    text = "\n".join(f"line {i % 50}" if i % 7 else f"own {i}" for i in range(20_000))
    got = kept_lines(spark, [(i, text.replace("own", f"own{i}")) for i in range(3)], min_docs=3)
    want = [x for x in text.split("\n") if x.startswith("own")]
    assert {g[1:3] for g in got} == {(20_000, 20_000 - len(want))}
    assert sorted(got)[0][3] == "\n".join(want).replace("own", "own0")


HARD = ["", "\\", "#", "### Assistant: x</turn>\n", "\\### User: \\\\</turn>", "a\nb", "</turn", "####", "é\U0001f600 <", ":"]


def test_turns_come_back():
    for role in ["user", "assistant", "a: b", "", "###", "x\\"]:
        for text in HARD:
            written, spans = chat.render(role, text)
            assert list(chat.read_turns(written * 2)) == [(role, text)] * 2
            if role == "assistant":
                assert "".join(chat.unescaped(written[a:b]) for a, b in spans) == text
    with pytest.raises(ValueError):
        list(chat.read_turns("### user: x"))


def test_events_fold(spark):
    log = [(1, "b", 1, "open", "assistant", "first"), (1, "b", 2, "regenerate", None, None), (1, "b", 3, "delta", None, "sec"), (1, "b", 4, "delta", None, "ond"),
           (1, "a", 1, "open", "user", "hel"), (1, "a", 2, "edit", None, "hello"), (1, "c", 1, "open", "user", "gone"), (1, "c", 2, "delete", None, None), (None, None, None, "open", None, None)]
    random.Random(1).shuffle(log)
    events = spark.createDataFrame(log, "conv_id bigint, message string, seq bigint, kind string, role string, text string").withColumn("formatted", F.lit(1))
    segments = [(r["conv_id"], r["formatted"]) for r in chat.format_log(events).collect()]
    assert [s for c, s in segments if c == 1] == ["### user: hello</turn>\n", "### assistant: second</turn>\n"]
    assert [s for c, s in segments if c is None] == ["### : </turn>\n"]


def test_conversations_round_trip(spark):
    rows = [(c, t, ["user", "assistant", None, "tool"][(c + t) % 4], HARD[(c * 3 + t) % len(HARD)] * (1 + 90 * (t == 2))) for c in range(9) for t in range(c)]
    rows += [(50, None, "user", "n"), (50, 0, "assistant", None), (50, -3, "user", "m"), (51, 0, "user", "same"), (51, 0, "user", "same"), (None, 0, "assistant", "q")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("message", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_log(chat.events_of(df))).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x[2] for x in turns if x[1] == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(chat.render(r, x)[0]) for _, r, x in turns)
    assert chat.digests(chat.format_log(chat.events_of(df.limit(0)))).count() == 0


def test_ids_are_those_of_whole_texts():
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(vocabulary_path())
    whole.encode_special_tokens = True
    rng = random.Random(2)
    alphabet = [" ", "  ", "\n", "\t", "a", "é", "'", "s", "'s", "'ll", "1", "!", "\xa0", "　", "Z", "\U0001f600", "́", "re", "ve", "\x85", " ", "\x1f", "-", "<|endoftext|>"]
    texts = ["", " "] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(3000)]
    ids, offs = tokens.Encoder(vocabulary_path()).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_new_pretokens_share_texts_and_a_table():
    """A new pre-token costs no text of its own in tokenizers, nor a copy of what is known; the ids stay those of single pre-tokens."""
    rng = random.Random(5)
    tool = tokens.Encoder(vocabulary_path())
    calls, tables, whole = [], [], tool.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return whole.encode_batch_fast(texts, **options)

    tool.tokenizer = Counting()
    seen = set()
    for _ in range(60):
        texts = ["".join(rng.choice([" ", " ", "\n", "", "  ", "!", "'ll", "\xa0"]) + "".join(rng.choices("aeiouéßЖ日12'", k=rng.randrange(1, 9))) for _ in range(40))
                 for _ in range(30)]
        ids, offs = tool.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        seen.update(texts)
        if not tables or tool.ids is not tables[-1]:  # kept, so that no two have one address
            tables.append(tool.ids)
    assert sum(calls) < 2_000  # of some 40,000 pre-tokens
    assert len(tables) <= 16  # doubled, not copied once a call
    again = len(calls)
    tool.encode(sorted(seen)[:50])
    assert len(calls) == again


def test_colliding_keys_and_a_full_vocabulary(monkeypatch):
    tool = tokens.Encoder(vocabulary_path())
    tool._slots(4)
    keys = np.array([(15 << 60) + i for i in range(1, 6)] + [3, 4, 5], np.uint64)  # all want the last slot or the first
    tool._put(keys, np.arange(8, dtype=np.int32))
    assert tool._find(keys).tolist() == list(range(8)) and tool._find(np.array([(15 << 60) + 9, 7, 1 << 62], np.uint64)).tolist() == [-1] * 3
    texts = [" ".join(f"w{i * 7 + j}x" for j in range(40)) for i in range(30)]
    want, offs = tokens.Encoder(vocabulary_path()).encode(texts)
    monkeypatch.setattr(tokens, "_VOCAB_LIMIT", 100)
    tool = tokens.Encoder(vocabulary_path())
    parts = [tool.encode([t])[0] for t in texts]
    assert (np.concatenate(parts) == want).all() and [len(p) for p in parts] == np.diff(offs).tolist()


def test_pretokens_that_do_not_keep_their_ends_are_encoded_apart():
    tool = tokens.Encoder(vocabulary_path())
    words = [" ab", "cd", " é", "'s", "12"]
    want = tool._encode_joined(words)
    tool.bytes_of = tool.bytes_of + 1  # as if the ids stood for other bytes
    got = tool._encode_joined(words)
    assert want[0].tolist() == got[0].tolist() and want[1].tolist() == got[1].tolist()


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["red", "blau", "été", "x1"]) for _ in range(rng.randrange(1, 900)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "long " * 9000), (3, rows[3][1]), (None, "no id")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS start", "2 AS length", "3 AS sequence_id")
    out = packing.pack(packing.kept(packing.token_pieces(df, vocabulary_path(), with_ids=True), "test-pieces")).collect()
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(vocabulary_path())
    want = sorted(([*whole.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows))
    pieces, sequences = {}, {}
    for r in out:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in out) == sum(map(len, want))
    single = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    for (doc, n), parts in pieces.items():
        assert [x for _, ids in sorted(parts)[:: 2 if doc == 3 else 1] for x in ids] == single[doc] and n == len(single[doc])
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(sequences) * 1024 <= 1.1 * sum(map(len, want)) + 2048
    assert packing.pack(packing.kept(packing.token_pieces(df.limit(0), vocabulary_path()), "test-pieces")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_cutting_stock_covers_and_is_tight(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(1, 65), 30, replace=False))
    demand = rng.integers(1, 60, 30).astype(float)
    plan = packing.cutting_stock(sizes, demand, 64)
    assert (sum(p * n for p, n in plan) == demand).all() and all((p * sizes).sum() <= 64 for p, _ in plan)
    assert sum(n for _, n in plan) <= first_fit_decreasing(sizes, demand, 64) + 31  # rounding costs at most one sequence a class


def first_fit_decreasing(sizes, demand, capacity):
    rooms = []
    for size in sorted((int(s) for s, n in zip(sizes, demand) for _ in range(int(n))), reverse=True):
        for i, room in enumerate(rooms):
            if room >= size:
                rooms[i] -= size
                break
        else:
            rooms.append(capacity - size)
    return len(rooms)


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(7)
    for _ in range(400):
        p, t = [[rng.randrange(4) for _ in range(rng.randrange(1, n))] for n in (70, 120)]
        assert decontaminate.myers(p, t) == slow_distance(p, t)


def test_edited_passages_are_found(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for i in range(25)]
    docs = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 150))]
        if i % 2:
            passage = edits(rng.choice(items)[1].split(), rng, rng.randrange(12), vocabulary)
            words[len(words) // 2:len(words) // 2] = [w.upper() + rng.choice(["", ",", "."]) for w in passage]
        docs.append((i, " ".join(words)))
    want = set()
    for d, text in docs:
        words = text.lower().replace(",", "").replace(".", "").split()
        for i, item in items:
            p = item.split()
            distance = slow_distance(p, words)
            if distance <= int(len(p) * 0.2) and words:
                want.add((d, i, distance, len(p)))
    extra = [(900, None), (901, ""), (None, items[0][1])]
    bench = spark.createDataFrame([*items, (70, None), (71, " ,"), (None, "w1")], "item_id bigint, text string").withColumn("distance", F.lit(1))
    df = spark.createDataFrame([*docs, *extra], DOCS).withColumn("item_id", F.lit(1))
    for words in (decontaminate.MAX_WORDS, 100):
        got = decontaminate.matches(df, bench, max_words=words).collect()
        assert {(r["id"], r["item_id"], r["distance"], r["item_words"]) for r in got} == want
    assert decontaminate.matches(df, bench.limit(0)).count() == 0 and decontaminate.matches(df.limit(0), bench).count() == 0


def test_items_that_share_an_id_are_all_searched(spark, tmp_path):
    import corpus_pipeline
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "pqrs"]
    edited = texts[1].replace("q3 ", "other ")
    docs = spark.createDataFrame([(1, "x " + texts[0]), (2, edited + " y"), (3, edited + " z " + texts[0]), (4, texts[2]), (5, texts[3]), (6, "clean text")], DOCS)
    bench = spark.createDataFrame([(0, texts[0]), (0, texts[1]), (0, texts[1]), (1, texts[2]), (None, texts[3])], "item_id bigint, text string")
    for words in (decontaminate.MAX_WORDS, 1):
        got = decontaminate.matches(docs, bench, max_words=words).collect()
        assert sorted(tuple(r) for r in got) == [(1, 0, 0, 20), (2, 0, 1, 20), (3, 0, 0, 20), (4, 1, 0, 20)]
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    whole = docs.selectExpr("*", "'en' AS lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars")
    assert [r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, whole, str(tmp_path)).collect()] == [6]


PAGE = ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-notice'>We use cookies</div><article><h1>A &amp; B</h1>"
        "<p>One  <b>two</b>\nthree<br>four<p>&#233;t&eacute; <script>var t='</p>';</script>done</p></article><aside>side</aside><section id=comments><p>first!</p></section><footer>&copy;</footer>")
MAIN = "A & B\nOne two three four\nété done"


def test_main_text(spark):
    assert html_text.best_path(PAGE) == ("body", "article")
    odd = "<body><div class=post1><p>" + "text " * 40 + "</p></div><div class=menu><p>menu</p></div>"
    rows = [(1, "http://h.com/a", PAGE), (2, "http://H.com:80/b", odd), (3, None, None), (4, "x", ""), (5, "http://h.com/c", "<p>bare"), (1, "http://h.com/a", PAGE), (None, "http://h.com/d", "<!-- <article>" + PAGE)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("_h", F.lit(1))
    got = [(r["page_id"], r["text"]) for r in html_text.extract(df).collect()]
    assert got.count((1, MAIN)) == 2 and (2, ("text " * 40).strip()) in got and (3, "") in got and (4, "") in got and (None, "") in got
    assert len(got) == len(rows) and html_text.extract(df.limit(0)).count() == 0


def test_host_decides_against_a_misleading_page(spark):
    """One page whose sidebar block is longer than its article follows the path of its host."""
    normal = "<body><div class='story'><p>" + "main words here " * 30 + "</p></div><div class='extra'><p>little</p></div></body>"
    odd = "<body><div class='story'><p>short article</p></div><div class='extra'><p>" + "other " * 60 + "</p></div></body>"
    df = spark.createDataFrame([(i, "http://a.org/x", normal) for i in range(6)] + [(9, "http://a.org/y", odd)], "page_id bigint, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}[9] == "short article"


def test_nested_split_and_minority_articles(spark):
    """Headline and lead around the winning container stay; a template of few pages is not cut to the line it has under the host's path."""
    words, lead = ("main words here " * 60).strip(), ("lead words here " * 15).strip()
    cases = {
        "nested": (f"<body><article><h1>Title</h1><p>Short lead</p><div class='content'><p>{words}</p></div></article></body>", f"Title\nShort lead\n{words}"),
        "post": (f"<body><div class='post'><h1>Title</h1><div class='content'><p>{words}</p></div></div><div class='extra'><p>little</p></div></body>", f"Title\n{words}"),
        "quote": (f"<body><div class='post'><p>Said:</p><blockquote>{words}</blockquote><p>End</p></div></body>", f"Said:\n{words}\nEnd"),
        "split": (f"<body><div class='intro'><p>{lead}</p></div><div class='text'><p>{words}</p></div><ul><li><a href='/x'>a link of the page</a></ul></body>", f"{lead}\n{words}"),
        "story": (f"<body><div class='story'><p>{words}</p></div></body>", words)}
    rows = [(f"http://{h}.org/{i}", page) for h, (page, _) in cases.items() for i in range(4)]
    other = f"<body><div class='story'><p>one short line</p></div><div class='column'><p>{lead * 3}</p></div></body>"
    rows += [("http://story.org/other", other), ("http://story.org/another", other)]
    got = {r["url"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "url string, html string")).collect()}
    for h, (_, want) in cases.items():
        assert [got[f"http://{h}.org/{i}"] for i in range(4)] == [want] * 4, h
    assert got["http://story.org/other"] == got["http://story.org/another"] == lead * 3


def archive(payloads, packed=True):
    records = [warc.record_of(i, f"http://a/{i}", p, None, False, "2000-01-01T00:00:00Z") for i, p in enumerate(payloads)]
    return [gzip.compress(r) if packed else r for r in records]


def read(data):
    return [(s, a, b, int(h["X-Page-ID"]) if s == "record" else h) for s, a, b, h, _ in warc.Reader(lambda at, n: data[at:at + n], len(data))]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = archive([b"one", b"two WARC/1.0\r\n not a start" * 3, b"", b"x" * 700_000, b"five"], packed)
    whole = b"".join(parts)
    ends = np.cumsum([0] + [len(p) for p in parts])
    assert read(whole) == [("record", ends[i], ends[i + 1], i) for i in range(5)]
    for hurt in range(5):
        data = bytearray(whole)
        at = int(ends[hurt] + ends[hurt + 1]) // 2 if packed else int(ends[hurt]) + 2
        data[at] ^= 0x55
        got = read(bytes(data))
        assert {g[3] for g in got if g[0] == "record"} >= set(range(5)) - {hurt} and len([g for g in got if g[0] == "gap"]) >= 1
        assert sorted([g[1] for g in got]) == [g[1] for g in got] and got[0][1] == 0 and got[-1][2] == len(data)
        assert all(a[2] == b[1] for a, b in zip(got, got[1:]))
    cut = read(whole[:-5])
    assert [g[3] for g in cut[:4]] == [0, 1, 2, 3] and cut[-1][0] == "gap"
    lost = whole[:ends[1]] + b"garbage" * 9 + whole[ends[2]:]
    assert [g[3] for g in read(lost) if g[0] == "record"] == [0, 2, 3, 4]
    assert read(b"") == [] and [g[0] for g in read(b"nothing here")] == ["gap"]


def test_archives(spark):
    rows = [(5, "http://a/\n5", "same"), (2, "u", "same"), (9, None, None), (7, "v", ""), (None, "w", "same"), (11, "x", "only ü"), (2, "u", "same"), (None, "n", "lone")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha", F.lit(1)).withColumn("refers_to", F.lit(1))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["status"]) for r in warc.read_archives(warc.write_archives(df, max_bytes=600)).collect()]
    of = lambda text: (len(text.encode()), warc.digest_of(text.encode()))
    want = [(5, *of("same"), "revisit", 2, "record"), *[(2, *of("same"), "response", None, "record")] * 2, (None, *of("same"), "revisit", 2, "record"), (7, *of(""), "response", None, "record"),
            (9, *of(""), "revisit", 7, "record"), (11, *of("only ü"), "response", None, "record"), (None, *of("lone"), "response", None, "record")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    small = {r["page_id"]: r["record_type"] for r in warc.read_archives(warc.write_archives(df, min_bytes=5)).collect()}
    assert set(small.values()) == {"response"}
