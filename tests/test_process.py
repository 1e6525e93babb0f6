"""External processes: success, failure, timeout and bad output, side by side."""

import sys

from tidemill.sources import process

SCRIPT = "import sys,time\nd=sys.stdin.read()\nif d=='slow': time.sleep(30)\nif d=='bad': sys.exit('broken')\nprint(d if d=='text' else '{\"n\": %d}' % len(d))"


def test_outcomes(spark):
    files = spark.createDataFrame([("a", b"abc"), ("b", b"bad"), ("c", b"slow"), ("d", b"text")], "path string, content binary")
    out = process.parsed(process.run_command(files, [sys.executable, "-c", SCRIPT], 5), "n int")
    got = {r.path: (r.value.n if r.value else None, r.error) for r in out.collect()}
    assert got["a"] == (3, None)
    assert got["b"][0] is None and got["b"][1].startswith("exit 1") and "broken" in got["b"][1]
    assert got["c"] == (None, "timeout after 5 s") and got["d"] == (None, "output is no JSON")
    assert process.run_command(files.limit(1), ["/no/such/program"]).first().error
