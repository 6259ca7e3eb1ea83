import gzip

import pytest

from cloudgrid.llm import warc
from cloudgrid.llm.common import local_path


@pytest.mark.parametrize("digest_only", [True, False])
@pytest.mark.parametrize("harm", [None, (b"whole page", b"wrong page"), (b"whole page", b"whole")])
def test_a_payload_unlike_its_headers_is_an_error(spark, tmp_path, harm, digest_only):
    index = warc.merge(warc.write(spark.createDataFrame([(1, "http://a.com/", "whole page")], "page_id bigint, url string, html string")))
    row = index.first()
    with open(local_path(row.path), "rb") as f:
        f.seek(row.offset)
        raw = gzip.decompress(f.read(row.length))
    if harm:
        assert raw.count(harm[0]) == 1
        raw = raw.replace(*harm)
    part = gzip.compress(raw)
    (tmp_path / "one.warc.gz").write_bytes(part)
    placed = [tuple({"path": str(tmp_path / "one.warc.gz"), "offset": 0, "length": len(part)}.get(c, row[c]) for c in index.columns)]
    read = warc.read(spark.createDataFrame(placed, index.schema), digest_only)
    if harm:
        with pytest.raises(Exception, match="its headers say"):
            read.collect()
    else:
        assert read.first().payload_bytes == 10
