"""Records are parsed once, whatever is asked of them."""

import re

from tickledger.functions import codec
from tickledger.sources import sample


def test_a_filter_on_the_reason_parses_no_text_again(spark, sf_dir):
    records = codec.decode_records(sample.envelope(spark, sf_dir, damaged=True))
    plan = codec.split_quarantine(records)[1].select("offset", "reason")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"from_json\(", plan)) <= 6
