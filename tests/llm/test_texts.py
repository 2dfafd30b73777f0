"""Tokens, secrets, URLs, archives and classifiers on small cases."""

import base64
import gzip
import hashlib
import io
import json
import random
import re

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import bpe, labelled, quality, secrets, toxicity, urls, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = regex.compile(public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("ast're lvmd  \n\t1!-_\U0010ffff")), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_split(text):
    assert bpe.split(text) == PATTERN.findall(text)


def test_bpe(spark, encoding):
    texts = ["", None, "The quick brown fox's den, isn't it?", "a" * 700, "xyz" * 200 + " " * 90 + "q", "日本語 テキスト ١٢٣", "\x00\x1c\u200b \U0001f600", "same", "same", "<|endoftext|>", "naïve  \n\n end "]
    docs = spark.createDataFrame([(i % 9, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    found = sorted((r.doc_id, r.n_tokens, list(r.ids), bytes(r.decoded)) for r in bpe.encode(docs, RANKS).collect())
    assert found == sorted((i % 9, len(e), e, (t or "").encode()) for i, t in enumerate(texts) for e in [encoding.encode_ordinary(t or "")])
    digests = {r.doc_id: r for r in bpe.encode(docs, RANKS, outputs=("ids_sha256", "decoded_sha256")).collect()}
    assert digests[2].ids_sha256 == hashlib.sha256(" ".join(map(str, encoding.encode_ordinary(texts[2]))).encode()).hexdigest()
    assert digests[2].decoded_sha256 == hashlib.sha256(texts[2].encode()).hexdigest()
    assert bpe.encode(docs.limit(0), RANKS).count() == 0


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ab", "etaoinshr", "กขคงจ", "ABCabc01"])
def test_long_pieces(encoding, letters):
    rng = random.Random(3)
    coder = bpe.Coder(RANKS)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (60, 95, 96, 97, 98, 300, 3000)]
    for text, (n, ids, data) in zip(texts, coder.encode(texts), strict=True):
        expected = encoding.encode_ordinary(text)
        assert ids == " ".join(map(str, expected)) and n == len(expected) and data == text.encode()


def test_pieces_are_forgotten_and_learned_again(encoding, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    coder = bpe.Coder(RANKS)
    for _ in range(12):
        texts = [" ".join(rng.choice(words[: rng.choice([5, 120])]) for _ in range(30)) for _ in range(3)] + [""]
        for text, (n, ids, data) in zip(texts, coder.encode(texts), strict=True):
            expected = encoding.encode_ordinary(text)
            assert ids == " ".join(map(str, expected)) and n == len(expected) and data == text.encode()


def test_a_very_long_piece_takes_little_time(encoding):
    import time

    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    coder, began = bpe.Coder(RANKS), time.perf_counter()
    [(n, ids, data)] = coder.encode([text])
    took = time.perf_counter() - began
    assert ids == " ".join(map(str, encoding.encode_ordinary(text))) and data == text.encode() and took < 30


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)]


def test_secrets(spark):
    rng = random.Random(8)
    parts = ["password", "PassWd", "ſecret", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "hunter22", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "0f", "é", ".", "\n", "🙂"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += [None, "", "key qZ7xV9pLw2KtR8mNc4YbH6sD here", "sha 2321bac4d15ec8f90433955bf9d3cf61da5bdd1e", "id 123e4567-e89b-12d3-a456-426614174000", "internationalization-of-the-people", texts[0]]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = {r.doc_id: r for r in secrets.report(docs, RANKS).collect()}
    for i, t in enumerate(texts):
        own = brute(t or "")
        assert found[i].base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest(), t
        assert [s for s in found[i].spans.split(",") if s and not s.startswith("token")] == own
        assert (found[i].n_assign, found[i].n_access, found[i].n_hex) == tuple(sum(s.startswith(k) for s in own) for k in ("assign", "access", "hex"))
    assert found[402].spans == "token:4:28" and found[404].spans == found[405].spans == ""
    many = " ".join(f"AKIA{k:016d} qZ7xV9pLw2KtR8mNc4Yb{k}" for k in range(20_000))
    assert len(secrets.token_spans(many, secrets._encoding(RANKS), secrets.base_spans(many))) == 20_000
    masked = {r.doc_id: r for r in secrets.mask(docs.withColumnRenamed("spans", "other"), RANKS).collect()}
    assert masked[402].text == "key [token] here" and masked[400].text is None
    assert secrets.report(docs.limit(0), RANKS).count() == 0


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
def test_random_strings_of_one_case_are_secrets(encoding, letters):
    rng = random.Random(9)
    runs = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 41))) for _ in range(300)]
    runs += ["-".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(5)) for _ in range(300)]
    assert sum(secrets.token_spans(f"key {r} here", encoding, []) == [(4, 4 + len(r), "token")] for r in runs) >= 0.93 * len(runs)


def test_names_of_words_are_no_secrets(encoding):
    for name in ("internationalization-of-the-people", "NOT_LIST_OR_STRING_OR_TUPLE", "getUserNameFromRequest2", "HAVE_SYS_SOUNDCARD_HEADER", "path/to/some_file_name"):
        assert secrets.token_spans(name, encoding, []) == [], name


def test_urls(spark):
    rng = random.Random(4)
    hosts = ["a.example.net", "Example.NET", "example.com", "x.org", "net", "y.info", "notexample.com", "a.b.org"]
    rows = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'EN'])}/{rng.randrange(50)}{rng.choice(['', '?page=2', '#top', '?a=1&b=2'])}") for i in range(300)]
    rows += [(300, None), (301, ""), (302, "no scheme"), (303, "http://"), (304, "x://NET?q"), (305, "ftp://Example.com:80/de/"), (306, rows[0][1]), (306, rows[0][1]), (None, "http://net/")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    found = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in urls.report(pages).collect()), key=repr)
    expected = []
    for i, u in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in urls.LIST if (host == h or host.endswith("." + h)) and path.startswith(p)]
        expected.append((i, host, path, *(max(fits)[1:] if fits else (None, None))))
    assert found == sorted(expected, key=repr)
    verdicts = {r.verdict for r in urls.report(pages).collect()}
    assert verdicts == {"allow", "block"}
    assert urls.report(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.report(pages.where("page_id >= 300 and page_id <= 303")).collect()} == {"allow"}


def tokens_of(url, host, path):
    labels = [x for x in host.split(".") if x]
    out = {"suffix:" + ".".join(labels[-i:]) for i in range(1, len(labels) + 1)} | ({"deeper"} if len(labels) >= 3 else set())
    out |= {f"step{i}:{re.sub('[0-9]+', '#', x)}" for i, x in enumerate((x for x in path.split("/") if x), 1)}
    out |= {"key:" + x.split("=")[0] for x in url.split("?", 1)[1].split("#")[0].split("&") if x} if "?" in url.split("#")[0] else set()
    return out | ({"scheme:" + url.split("://")[0].lower()} if "://" in url else set())


def test_verdicts_of_urls_without_a_listed_rule(spark):
    rng = random.Random(14)
    hosts = ["a.example.net", "b.deep.er.example.net", "net", "shop.net", "example.com", "x.org", "y.org", "z.info", "w.info", "k.q.z.info"]
    rows = [(i, f"https://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{rng.choice(['a', 'b'])}/c{rng.choice(['', '/deal', '/deal/9'])}{rng.choice(['', '?p=1', '?a=1&b=2&c=3&d=4&utm=5', '?utm=1'])}") for i in range(240)]
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), min_support=0.02).collect()}
    sets = {i: tokens_of(u, found[i].host, found[i].path) for i, u in rows}
    known = [(sets[i], found[i].verdict) for i, _ in rows if found[i].rule]
    holders = {t: frozenset(k for k, (s, _) in enumerate(known) if t in s) for s, _ in known for t in s}
    first = {}
    names = {t: first.setdefault(holders[t], t) for t in sorted(holders) if len(holders[t]) >= 0.02 * len(known)}
    short = lambda s: {names[t] for t in s if t in names}
    known = [(short(s), v) for s, v in known]
    mined = 0
    for i, _ in rows:
        if found[i].rule:
            continue
        own, best, held = sorted(short(sets[i])), [], {}
        for k in range(1, 1 << len(own)):
            some = {t for j, t in enumerate(own) if k >> j & 1}
            every = [v for s, v in known if some <= s]
            for v in set(every):
                if every.count(v) >= 0.02 * len(known) and every.count(v) >= 0.8 * len(every):
                    held[frozenset(some), v] = every.count(v) / len(every)
                    best.append((every.count(v) / len(every), every.count(v), len(some), v == "block", v, sorted(some)))
        best = [r for r in best if not any(s < set(r[5]) and v == r[4] and c >= r[0] for (s, v), c in held.items())]
        assert (found[i].verdict, found[i].mined) == (max(best)[4:] if best else ("allow", None))
        mined += bool(best)
    assert mined > 20


def test_mined_rules_need_confidence_and_are_pruned(spark):
    rows = [(["a", "b"], "block")] * 40 + [(["a", "c"], "allow")] * 40 + [(["b", "d"], "block")] * 20 + [(["e"], "allow"), (["e"], "block")] * 10
    rules = {tuple(r.antecedent): r.verdict for r in urls.prune(urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))).collect()}
    assert rules == {("b",): "block", ("c",): "allow", ("d",): "block"}


def test_warc(spark):
    big = "<p>é" * 60
    rows = [(5, "u", big), (3, "ü\n", big), (9, None, big), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (7, "u", "x" * 99), (8, "u", "x" * 99), (10, "u", "WARC/1.1\r\n\r\n" * 3000), (None, "u", big), (3, "again", big)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    found = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.report(pages).collect()), key=repr)
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((j for j, _, h in rows if j is not None and (h or "").encode() == data), default=None)
        again = len(data) >= 100 and i is not None and first < i
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert found == sorted(expected, key=repr)
    assert warc.report(pages.limit(0)).count() == 0


def test_warc_members_stand_alone(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}" * 50) for i in range(20)], "page_id long, url string, html string").coalesce(2)
    made, folder = warc.archive(pages, f"file://{tmp_path}/w")
    assert sum(r.members for r in made.collect()) == 20 and not (tmp_path / "w/streams").exists()
    for r in made.collect():
        data = (tmp_path / "w/members" / r.archive).read_bytes()
        for line in (tmp_path / "w/members" / (r.archive[:-8] + ".idx")).read_text().splitlines():
            offset, length, _, page = line.split()
            one = gzip.decompress(data[int(offset) : int(offset) + int(length)])
            assert one.startswith(b"WARC/1.1\r\n") and f"X-Page-Id: {page}\r\n".encode() in one
        assert len(list(warc.records(warc.Inflating(io.BytesIO(data))))) == r.members
    with pytest.raises(ValueError, match="breaks off"):
        list(warc.records(warc.Inflating(io.BytesIO(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))))


def test_warc_tasks_can_run_again(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i} é", f"<p>{i % 7}" * 50) for i in range(20)], "id long, uri string, html string").coalesce(1)
    rows = pages.selectExpr("id", "uri", "encode(html, 'UTF-8') as payload", "sha2(html, 256) as digest", "cast(length(html) as long) as size", "cast(null as long) as refers_to")
    base = warc.qualified(spark, str(tmp_path))
    assert base.startswith("file:")
    written = spark.createDataFrame(warc.write(rows, f"{base}/streams").collect(), "archive string, n long")
    once, again = (spark.createDataFrame(warc.normalise(written, f"{base}/streams", f"{base}/members").collect(), "archive string, members long") for _ in range(2))
    first, second = (sorted(map(tuple, warc.read(made, f"{base}/members").collect())) for made in (once, again))
    assert first == second and [(r[0], r[1]) for r in first] == [(i, f"http://h/{i} é") for i in range(20)]
    with pytest.raises(ValueError, match="can't be written"):
        warc.qualified(spark, "http://x/y")


def test_warc_streams_that_break_off(spark):
    whole = gzip.compress(b"".join(warc.record("response", "u", str(i), b"abc" * 2000, "d", 6000) for i in range(3)), mtime=0)
    assert len(list(warc.records(warc.Inflating(io.BytesIO(whole))))) == 3
    for cut in (len(whole) - 1, len(whole) - 9, len(whole) // 2):
        with pytest.raises(ValueError, match="breaks off"):
            list(warc.records(warc.Inflating(io.BytesIO(whole[:cut]))))


def near(a, b):
    """Within one insertion, deletion, change or swap of neighbours."""
    if a == b:
        return True
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    s, t = sorted((a, b), key=len)
    return len(t) == len(s) + 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=3, max_size=7), min_size=1, max_size=6), st.text("abc", max_size=8))
def test_automaton(terms, word):
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 1.0), {}, set(terms))
    assert (lexicon.near(word) is not None) == any(near(t, word) for t in terms)


def labelled_corpus(spark):
    rng = random.Random(6)
    words = [a + b + c for a in "ka lo mi nu".split() for b in "ba de fi go".split() for c in "ra so tu".split()]
    docs, labels = [], []
    for i in range(500):
        text = [rng.choice(words) for _ in range(60)]
        toxic, good = i % 5 == 0, i % 4 != 0
        if toxic:
            for w in rng.sample(["zzidiot", "zzmoron", "zzscum"], 2):
                text[rng.randrange(60)] = w
        if not good:
            text = [w.upper() + "!!" for w in text]
        docs.append((i, " ".join(text), "en", "src"))
        labels.append((i, int(good), int(toxic)))
    docs += [(1000, None, None, None), (1001, "", None, None), (None, "kabara " * 5, None, None), (1002, "you zzmoorn and zzidiott", "en", "s"), (1003, "lofiso " * 100_000, "en", "s"), (0, docs[0][1], "en", "src")]
    labels += [(5, None, 1), (0, 1, 1), (None, 0, 1), (7777, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers(spark):
    docs, labels = labelled_corpus(spark)
    truth = {r.doc_id: r for r in labels.where("doc_id < 500").collect()}
    for report, name, cut in ((toxicity.report, "toxic", 0.5), (quality.report, "quality", 0.3)):
        rows = report(docs, labels).collect()
        assert len(rows) == 506 and all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in rows)
        held = [r for r in rows if r.held_out and r.doc_id in truth]
        assert 60 < len(held) < 140
        right = sum(r.predicted == truth[r.doc_id][name] for r in held)
        assert right >= 0.97 * len(held), (name, right, len(held))
        score = {r.doc_id: r.score for r in rows}
        if name == "toxic":
            assert score[1002] > 0.5 > score[1003] and score[1000] == score[1001] < 0.5
        assert report(docs.limit(0), labels).count() == 0
        assert {r.predicted for r in report(docs.limit(5), labels.limit(0)).collect()} == {0}
    left = toxicity.reject(docs, labels)
    assert left.columns == docs.columns and 390 <= left.count() <= 410


def test_a_shared_banner_does_not_hide_toxic_rows(spark):
    rng = random.Random(12)
    words = [a + b + c for a in "ka lo mi nu".split() for b in "ba de fi go".split() for c in "ra so tu".split()]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    banner, footer = text(12), text(12)
    docs = [(i, f"{banner} {text(30)} {'zzidiot' if i % 4 == 0 else ''} {text(30)} {footer}" if i % 4 == 0 else text(70)) for i in range(200)]
    docs += [(200 + i, docs[4][1].replace("zzidiot", f"zzidiot qqchance w{i}")) for i in range(60)]
    labels = [(i, int(i % 4 == 0 or i >= 200)) for i, _ in docs]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "zzidiot" in model.lexicon.terms and "qqchance" not in model.lexicon.terms


def test_held_out(spark):
    import zlib

    rows = spark.range(300).selectExpr("id as doc_id").union(spark.sql("select cast(null as bigint)")).withColumn("h", labelled.held_out()).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_quotation_counts_less():
    lexicon = toxicity.Lexicon({"moron": 5.0}, {})
    abuse, quoted = (toxicity.features(*toxicity.hits(t, lexicon)) for t in ("you are a moron indeed", 'they said “moron” in the report'))
    assert abuse[0] > 0 == abuse[1] and quoted[1] > 0 == quoted[0] and abuse[3] > quoted[3]
    assert json.dumps(abuse)


def test_hits_and_their_context_by_brute_force():
    rng = random.Random(21)
    lexicon = toxicity.Lexicon({"moron": 5.0, "scum": 4.0, "idiot": 6.0}, {"wret": 3.0}, {"moron", "idiot"})
    pool = ["moron", "Moron!", "m0ron", "morn", "scum", "scun", "idiots", "wretched", "said", "you", "“", "”", '"', "a", "b", "word", "fine", "x-idiot", "it's"]
    for _ in range(300):
        words = [rng.choice(pool) for _ in range(rng.randrange(25))]
        expected = []
        for i, w in enumerate(words):
            found = []
            for core in toxicity.cores(w.lower()):
                if core in lexicon.terms:
                    found.append((lexicon.terms[core], 0, core))
                elif core.startswith("wret") and len(core) > 4:
                    found.append((3.0, 0, "wret"))
                elif len(core) >= 4 and (close := [t for t in ("moron", "idiot") if near(t, core)]):
                    term = max(close, key=lambda t: (lexicon.terms[t], t))
                    found.append((lexicon.terms[term], 1, term))
            if not found:
                continue
            weight, edits, term = max(found, key=lambda f: (f[0], -f[1], f[2]))
            before, after = words[max(0, i - 6) : i], words[i + 1 : i + 7]
            around = {c for x in before + after for c in toxicity.cores(x.lower())}
            opened = sum(x.count(m) for x in before for m in toxicity.MARKS)
            closed = any(m in x for x in after for m in toxicity.MARKS)
            expected.append((term, weight, edits, bool(opened % 2 and closed) or bool(around & toxicity.REPORTING), bool(around & toxicity.ADDRESS)))
        assert toxicity.hits(" ".join(words), lexicon) == (expected, len(words))


def test_lexicon_by_brute_force(spark):
    from math import log

    docs, labels = labelled_corpus(spark)
    model = toxicity.fit(docs, labels)
    text = {r.doc_id: r.text for r in docs.where("doc_id < 500").collect()}
    held = {r.doc_id for r in docs.where("doc_id < 500").withColumn("h", labelled.held_out()).where("h").collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1 and doc_id < 500").collect()}
    rows = [(set(text[i].lower().replace("!!", "").split()), i in toxic) for i in text if i not in held]
    n, m = sum(t for _, t in rows), sum(not t for _, t in rows)
    expected = {}
    for w in set().union(*(s for s, _ in rows)):
        t, c = sum(w in s and y for s, y in rows), sum(w in s and not y for s, y in rows)
        odds = log((t + 0.5) / (n + 1) / ((c + 0.5) / (m + 1)))
        evidence = 2 * ((t * log(t / (t + c) / (n / (n + m))) if t else 0) + (c * log(c / (t + c) / (m / (n + m))) if c else 0))
        if t >= 2 and odds >= toxicity.MIN_ODDS and evidence >= toxicity.MIN_EVIDENCE:
            expected[w] = odds
    assert set(expected) == {"zzidiot", "zzmoron", "zzscum"} == set(model.lexicon.terms)
    assert all(abs(model.lexicon.terms[w] - expected[w]) < 1e-9 for w in expected)


def test_context_vectors_and_pooling_by_brute_force(spark):
    import numpy as np
    import pyarrow as pa

    from tessel.llm import text as tx

    rng = random.Random(2)
    words = [a + b for a in ("ka", "LO", "mi9", "né", "x.") for b in ("ba", "de", "", "GO", "!")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(30)] + [None, ""]
    described = []
    for t in texts:
        [(_, _, block)] = list(tx.blocks(pa.array([t], pa.string()), tx.NOT_SPACE))
        shape, bucket, _ = quality.describe(block)
        described.append(list(zip(shape.tolist(), bucket.tolist(), strict=True)))
    total = np.zeros((quality.SHAPES + quality.BUCKETS, quality.SIZE))
    for own in described:
        for i, names in enumerate(own):
            for j in range(max(0, i - quality.NEAR), min(len(own), i + quality.NEAR + 1)):
                if j != i:
                    for name in names:
                        total[name] += quality.INDEX[own[j][0]] + quality.INDEX[own[j][1]]
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, doc_id long").repartition(3)
    vectors = quality.contexts(docs)
    assert np.abs(vectors - total).max() < 2e-6
    [(_, _, block)] = list(tx.blocks(pa.array(texts, pa.string()), tx.NOT_SPACE))
    pooled = quality.pool(block, vectors)
    for row, own in zip(pooled, described, strict=True):
        parts = [np.array([f(s, b) for s, b in own]).reshape(-1, quality.SIZE) for f in (lambda s, b: vectors[b], lambda s, b: vectors[s], lambda s, b: quality.INDEX[s], lambda s, b: quality.INDEX[b])]
        expected = [p.mean(axis=0) if len(p) else np.zeros(quality.SIZE) for p in parts] + [parts[0].std(axis=0) if len(own) else np.zeros(quality.SIZE)]
        assert np.abs(row - np.concatenate(expected)).max() < 1e-5


def test_temperature_calibrates():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 20))
    y = (rng.random(1500) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    network = quality.Network(x, y, np.ones(1500))
    fresh = rng.standard_normal((4000, 20))
    truth = (rng.random(4000) < 1 / (1 + np.exp(-2 * fresh[:, 0]))).astype(int)
    loss = lambda p: -np.log(np.where(truth == 1, p, 1 - p)).mean()
    calibrated = loss(network.scores(fresh))
    warm, network.temperature = network.temperature, 1.0
    assert warm != 1.0 and calibrated < loss(network.scores(fresh))


def test_classifiers_take_clashing_columns_ties_and_repeated_rows(spark):
    docs, labels = labelled_corpus(spark)
    clash = docs.selectExpr("doc_id", "text", "lang as score", "source as y", "'p' as predicted", "'h' as held_out", "1 as id", "2 as key", "'l' as toxic", "'q' as quality")
    again = clash.unionByName(clash.where("doc_id < 3"))
    more = labels.selectExpr("*", "'t' as text", "1 as y", "2 as id", "0.5 as score")
    for report in (toxicity.report, quality.report):
        plain = {r.doc_id: r for r in report(docs, labels).where("doc_id is not null").collect()}
        found = report(clash, more).collect()
        assert len(found) == 506
        assert [(report.__module__, r.doc_id, r.score, plain[r.doc_id].score) for r in found if r.doc_id is not None and abs(r.score - plain[r.doc_id].score) > 1e-6] == []
        # repeated rows count in a corpus each time, so the context vectors may differ with them
        found = report(again, more).collect()
        assert len(found) == 510
        assert [r for r in found if r.doc_id is not None and r.doc_id < 500 and r.predicted != plain[r.doc_id].predicted] == []
    assert toxicity.reject(clash, more).columns == clash.columns
