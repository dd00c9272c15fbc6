from datetime import datetime

import pytest

from quillmill.functions import urls
from quillmill.functions.dates import dates_in

NOW = datetime(2024, 6, 15, 12)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Posted 2023-04-05T10:00 by me", [(2023, 4, 5)]),
        ("on 10/12/98, 1-2-2003 and 3/4-05", [(1998, 10, 12), (2003, 1, 2)]),
        ("13/12/2020 is no month, 2/30/2020 no day", []),
        ("1 / 2 / 2020", []),
        ("MARCH 3rd, 2019; Sept. 9 2018; may 5", [(2019, 3, 3), (2018, 9, 9), (2024, 5, 5)]),
        ("the 21st of December 2014, 4 Jul 1999, 5. Oct. 2001", [(2014, 12, 21), (1999, 7, 4), (2001, 10, 5)]),
        ("Monday the 23rd, tues. 4", [(2024, 6, 23), (2024, 6, 4)]),
        ("version 1.2.3, 192.168.1.1, phone 555-12-3456, 12345-01-02", []),
        ("", []),
        ("é 你好 31 June", []),
    ],
)
def test_dates(text, want):
    assert [(d.year, d.month, d.day) for d in dates_in(text, NOW)] == want


def test_anchor_targets(spark):
    html = """<A class="x" HREF='/a?b="c"'>1</A><a href=/d>2</a><a
    title='t' href = "e f">3</a><abbr href="/no">4</abbr><a name="g">5</a><a href="">6</a><a data-href="/no" href="/yes">7</a>"""
    got = spark.createDataFrame([(html,), (None,)], "h string").select(urls.anchor_targets(urls.F.col("h")).alias("t")).collect()
    assert got[0].t == ['/a?b="c"', "/d", "e f", "", "/yes"] and got[1].t is None
