"""Archives: records, index and lookups."""

import random
import zlib

from chartloom.llm import store, warc

SCHEMA = "page_id long, url string, html string"


def pages():
    rng = random.Random(1)
    bodies = [f"<p>{rng.random()} é {'x' * rng.randint(0, 3000)}</p>" for _ in range(40)]
    rows = [(i, f"http://www.site{i % 7}.example.org/{rng.randint(0, 9)}?q={i}", rng.choice(bodies)) for i in range(300)]
    rows += [(1000 + i, "https://hot.example.com/", "same") for i in range(60)]
    return rows + [(2000, None, None), (2001, "not a url", ""), (2002, "http://[bad", "x\r\n\r\ny\x00"), (None, "http://a.b/", "same"),
                   (2003, "http://é.example:8080/ü x\n", "z" * 200000), (2004, "", "only")]


def test_reversed_host():
    assert warc.reversed_host("http://www.a.Example.org:80/x?q=1#f") == "org,example,a)/x?q=1"
    assert warc.reversed_host("https://u@b.org:8443") == "org,b:8443)/"
    assert warc.reversed_host(None) == warc.reversed_host("http://[x") == warc.reversed_host("plain") == "-"


def test_record_round_trip():
    body = "a\r\n\r\né".encode()
    digest = warc.sha1_base32(body)
    data = warc.record(7, "http://x/ y\n", body, digest, None)
    assert warc.parse_record(data) == (7, "http://x/%20y%0A", body, len(body), digest, "response", None)
    again = warc.parse_record(warc.record(8, None, body, digest, (7,)))
    assert again == (8, None, None, len(body), digest, "revisit", 7)


def test_archives_index_and_lookups(spark):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    folder = store.new_path(spark, "warc-test")
    captures = warc.write_archives(df, folder + "/archives")
    directory = warc.write_index(captures, folder + "/index", lines=20)
    assert directory.count() > 10
    # every range of the directory is one gzip block, and all lines are in order over the whole index
    files, path = warc._files(folder + "/index")
    lines = []
    for d in sorted(directory.collect(), key=lambda d: (d.first, d.offset)):
        with files.open_input_file(f"{path}/{d.part}") as file:
            file.seek(d.offset)
            block = zlib.decompress(file.read(d.length), 31).decode().split("\n")[:-1]
        assert block[0].rsplit("\t", 3)[0] == d.first and block[-1].rsplit("\t", 3)[0] == d.last and len(block) <= 20
        lines += [x.rsplit("\t", 3)[0] for x in block]
    assert lines == sorted(lines) and len(lines) == len(rows)
    # by address: all captures, over blocks and parts
    ask = spark.createDataFrame([("com,example,hot)/\t",), ("org,nowhere)/",), (None,), ("com,example,hot)/\t",)], "key string")
    assert warc.look_up(directory, folder + "/index", ask).count() == 60
    one = spark.createDataFrame([(warc.key_of(*rows[5][1::-1]),)], "key string")
    place = warc.look_up(directory, folder + "/index", one)
    read = warc.read_records(place, folder + "/archives").collect()
    assert [r.page_id for r in read] == [5]


def test_every_row_comes_back(spark):
    rows = pages()
    got = {r.page_id: r for r in warc.archive_round_trip(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    for i, _, html in rows:
        body = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.sha1_base32(body))
        if first[html or ""] == i:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, body)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", first[html or ""], None)


def test_small_payloads_are_not_revisited(spark):
    df = spark.createDataFrame([(1, "http://a/", "xx"), (2, "http://a/", "xx"), (3, "http://a/", "yyyy"), (4, "http://a/", "yyyy")], SCHEMA)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_round_trip(df, revisit_from=3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "http://a/", "x"), (1, "http://a/", "x"), (2, None, "x")], SCHEMA)
    got = sorted((r.page_id, r.record_type) for r in warc.archive_round_trip(df).collect())
    assert got == [(1, "response"), (1, "response"), (2, "revisit")]
