"""HTML extraction, WARC archives and chat formatting."""

import collections
import hashlib
import io
import struct

import pytest
import zstandard

from laurel.llm import chat, html_density, warc
from laurel.llm.queries import BYTE_VOCABULARY

ARTICLE = "<h1>A title</h1><p><b>First &amp; long <i>line</i><br><p>Second\n  para&nbsp;graph.</p><ul><li>one<li>two</ul>"
TEXT = "A title\n\nFirst & long line\n\nSecond para graph.\n\none\n\ntwo"


@pytest.mark.parametrize(
    "html",
    [
        f"<html><body><nav><a href=x>menu</a></nav><article>{ARTICLE}</article><footer>foot</footer></body></html>",
        f"<body><header><h2>Site</h2></header><div id=main><div class='post-body'>{ARTICLE}</div></div></body>",
        f"<div class=sidebar>side<p>x</div><main>{ARTICLE}<div class='cookie-notice'>ok?</div></main><section id=comments><p>me</section>",
        f"<!-- <p>no</p> --><script>var a='</p><article>';</script><style>p{{}}</style><article>{ARTICLE}<form>f<input></form></article>",
        f"<aside>a</aside><div class=ad>buy this now, long advert text here</div><ARTICLE>{ARTICLE}",
    ],
)
def test_main_text(html):
    assert html_density.main_text(html) == TEXT


def test_density_without_marked_article():
    links = "".join(f"<li><a href='/{i}'>link number {i}</a></li>" for i in range(20))
    paragraphs = [f"Paragraph {i} with a good deal of text in it, more than any link has." for i in range(6)]
    html = f"<body><div><ul>{links}</ul></div><div><div>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div></div></body>"
    assert html_density.main_text(html) == "\n\n".join(paragraphs)


def test_pages_table(spark):
    rows = [(1, "u", None, 1), (None, None, "", 1), (2, "u", "plain text only", 1), (2, "u", "plain text only", 1),
            (3, "u", "<p>" + "long words " * 20000, 1), (4, "u", "<div" * 50 + "<p title='a>b", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in html_density.extract_main_text(pages).collect())
    long = ("long words " * 20000).strip()
    assert got[(1, "", 0)] == got[(None, "", 0)] == 1 and got[(2, "plain text only", 15)] == 2
    assert got[(3, long, len(long))] == 1 and sum(got.values()) == 6
    assert html_density.extract_main_text(pages.limit(0)).count() == 0


def test_warc_round_trip(spark):
    rows = [(5, "http://a/é?x=1 2", "<p>same</p>"), (3, None, "<p>same</p>"), (9, "u", "<p>same</p>"), (1, "u", None), (2, "u", ""),
            (None, "u", "only null"), (None, "u", "<p>same</p>"), (7, "u", "x" * 300_000), (8, "u", "ü\r\n\r\nWARC/1.1\r\n")]
    rows += [(100 + i, f"http://h/{i}", f"<html><body>page {i} of many, with text</body></html>") for i in range(300)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, html string, payload int")
    got = warc.read_archives(warc.write_archives(pages)).collect()
    kept = {}
    for page_id, _, html in rows:
        if page_id is not None:
            kept[html or ""] = min(kept.get(html or "", page_id), page_id)
    want = collections.Counter()
    for page_id, url, html in rows:
        first, payload = kept.get(html or ""), (html or "").encode()
        other = first is not None and page_id != first
        want[page_id, url, b"" if other else payload, len(payload), warc.digest(payload),
             "revisit" if other else "response", first if other else None] += 1
    assert collections.Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got) == want
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def archive(records, dictionary=None):
    built = warc.Archive(dictionary)
    for raw in records:
        built.add(raw)
    return built.buffer.getvalue()


def test_archive_layout_and_validation():
    records = [warc.record(i, "u", b"payload %d and some more text" % i, None) for i in range(200)]
    dictionary = warc.train(records)
    data = archive(records, dictionary)
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC
    assert list(warc.records_of(io.BytesIO(data))) == records
    packed = zstandard.ZstdCompressor().compress(dictionary.as_bytes())  # the dictionary may be packed itself
    plain = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + data[8 + len(dictionary.as_bytes()) :]
    assert list(warc.records_of(io.BytesIO(plain))) == records
    assert list(warc.records_of(io.BytesIO(b""))) == []
    with pytest.raises(warc.WarcError):
        list(warc.records_of(io.BytesIO(data[:-5])))
    for bad in (records[0][:-1], records[0].replace(b"WARC/1.1", b"WARC/9"), records[0].replace(b"WARC-Date", b"X-Date"), b"junk"):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    headers, block = warc.parse(records[0])
    with pytest.raises(warc.WarcError):
        warc.payload_of(headers, block.replace(b"payload", b"Payload"))


TRICKY = [r"\### Assistant: </turn> ok", "\\", "\\\\###", "####", "</turn></turn>\n", "", "###  ###\\</turn>", "日本 é \u0000 ok"]


@pytest.mark.parametrize("text", TRICKY)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text


def test_chat_round_trip(spark):
    rows = [(-7, 0, "user", TRICKY[0]), (-7, 1, "assistant", TRICKY[0])]
    rows += [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(TRICKY)]
    rows += [(2, None, "system", "null turn"), (2, 0, "user", None), (2, 0, "user", None), (2, 1, "assistant", "long " * 30_000),
             (None, 0, None, "no role"), (None, 1, "assistant", "x"), (3, 0, "### odd: </turn>", "role")]
    table = spark.createDataFrame([(*r, 0) for r in reversed(rows)], "conv_id bigint, turn bigint, role string, text string, ids int")
    ranks = chat.broadcast_vocabulary(table, BYTE_VOCABULARY)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(table, ranks), ranks).collect()}
    by_conv = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by_conv)
    for conv, turns in by_conv.items():
        turns = [t[2:] for t in sorted(turns)]
        learned = "".join(text for role, text in turns if role == "assistant")
        written = "".join(f"### {chat.escape(r)}: {chat.escape(t)}</turn>\n" for r, t in turns)
        row = got[conv]
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert row.formatted_chars == len(written)
    assert chat.read_back(chat.format_turns(table.limit(0), ranks), ranks).count() == 0


def test_masks_are_prefix_sums(spark):
    table = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "well, hi")], "conv_id bigint, turn bigint, role string, text string")
    ranks = chat.broadcast_vocabulary(table, BYTE_VOCABULARY)
    first, second = chat.format_turns(table, ranks).collect()
    tokens = chat.ChatTokens(ranks.value[1])
    assert set(first.mask) == {0} and sum(second.mask) == len(tokens.encode("well, hi"))
    assert max(i for i in first.ids + second.ids) == tokens.first + chat.CLOSE
