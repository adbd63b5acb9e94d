"""Response records by Spark's own functions: equal to records made in Python, one Python worker a task."""

import base64
import hashlib
import uuid

from retentio.llm import op10_warc


def test_responses_take_no_python_worker_and_keep_their_ids(spark):
    rows = [(1, "http://a.org/\r\nx", "<p>\u00e4\U0001f600</p>"), (1, "http://a.org/\r\nx", "<p>\u00e4\U0001f600</p>"), (None, None, None),
            (2**60 + 1, "", "a\r\n\r\nb"), *((i, f"http://b.org/{i}", "x" * i) for i in range(3, 40))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sha = lambda t: "sha1:" + base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want, seen = [], {}
    for row in rows:
        page, url, html = row[0], row[1] or "", row[2] or ""
        seen[row] = seen.get(row, 0) + 1
        rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response:{page}:{url}:{sha(html)}:{seen[row]}')}>"
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html.encode())}\r\n\r\n{html}"
        head = [("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", op10_warc.DATE),
                ("WARC-Target-URI", url.replace("\r", " ").replace("\n", " ")), ("WARC-Payload-Digest", sha(html)), ("WARC-Block-Digest", sha(block)),
                ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block.encode())))]
        want.append((page, "response", rid, None, url, op10_warc.DATE, "application/http; msgtype=response", sha(block), sha(html),
                     len(block.encode()), "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in head)]), block))
    got = op10_warc.responses(pages)
    assert [f.simpleString() for f in got.schema] == [f.replace(" ", ":").replace("long", "bigint") for f in op10_warc.RECORD.split(", ")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    plan = op10_warc.op10_query(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1
    derived = op10_warc.op10_query(pages).collect()
    assert sorted(r.refers_to for r in derived) == sorted(2 * [w[2] for w in want])
