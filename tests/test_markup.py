"""Captured pages: the tag walk, page states and quotes, RPC blocks, and quotes of metasearch cards."""

import pytest

from tidemark.sources import markup, pages


def card(total='<span class="fare-total" data-amount="6120">₹</span>', base="5,000", tax=1120, name='<span class="airline-name">Any Air</span>'):
    return f'<div id="c" class="wide flight-card x">{name}<b class="airline-code">QP</b><i class="flight-number">QP-77</i>{total}<span class="fare-base">₹{base}</span><span class="fare-taxes">{tax}</span></div>'


ROW = '<tr data-airline="SpiceJet" class="flight-row" data-flight-number="SG-12" data-airline-code="SG"><td class="fare-total"><b>₹</b>7,310</td><td class="dep-time"> 6:05 </td></tr>'
WHOLE = ("SUCCESS", 1, 0, "QP", "Any Air", "QP-77", 6120.0, 5000.0, 1120.0, None, None)


@pytest.mark.parametrize(
    "html, expected",
    [
        (card(), [WHOLE]),
        (card() + card(tax=1), [WHOLE]),  # parts that do not add up leave the page
        (card(total="<span class='a fare-total'><b>₹</b><i><u>6,</u>120</i></span>"), [WHOLE]),
        (card(total='<span data-amount="" class="fare-total">6120<br>.00</span>'), [WHOLE]),
        (card(name='<span class="airline-name">Any<!-- x --> <b>Air</b></span>'), [(*WHOLE[:4], "AnyAir", *WHOLE[5:])]),
        (card(tax=1), [("SELECTOR_DRIFT", 0, None, *[None] * 8)]),
        (card(name=""), [("SELECTOR_DRIFT", 0, None, *[None] * 8)]),
        (card(tax=1) + f"<table>{ROW}</table>", [("SUCCESS", 1, 0, "SG", "SpiceJet", "SG-12", 7310.0, None, None, "6:05", None)]),
        ('<table><tr class="flight-row"><td class="fare-total">none</td></tr></table>', [("NO_RESULTS", 0, None, *[None] * 8)]),
        ('<table><tr class="flight-row"><td>7</td></tr></table>', [("SELECTOR_DRIFT", 0, None, *[None] * 8)]),
        (card() + '<div class="x error-container">', [("ERROR", 0, None, *[None] * 8)]),
        ("<h1>HTTP <b>500</b></h1>" + card(), [("ERROR", 0, None, *[None] * 8)]),
        ("<h1>ok</h1><h1>500</h1>" + card(), [WHOLE]),
        ('<p id="cf-challenge">' + card(), [("CAPTCHA_CHALLENGE", 0, None, *[None] * 8)]),
        ("Please VERIFY you are a human", [("CAPTCHA_CHALLENGE", 0, None, *[None] * 8)]),
        ('<div class="empty-state">' + card(), [("NO_RESULTS", 0, None, *[None] * 8)]),
        ('<p class="flight-card">' + "</div></b>", [("NO_RESULTS", 0, None, *[None] * 8)]),
        ("", [("NO_RESULTS", 0, None, *[None] * 8)]),
        (None, [("NO_RESULTS", 0, None, *[None] * 8)]),
        ("<div>" * 5000 + card(), [WHOLE]),
    ],
)
def test_pages(html, expected):
    assert markup.page_rows(html) == expected


def test_table_function_keeps_columns_and_pages_without_quotes(spark):
    rows = [(1, card() + card(), "s"), (2, None, "t"), (3, card(tax=1), "u"), (4, f"<table>{ROW}</table>", "v"), (4, f"<table>{ROW}</table>", "v")]
    found = markup.page_quotes(spark.createDataFrame(rows, "page int, h string, fares string"), "h").collect()
    assert sorted((r.page, r.fares, r.state, -1 if r.place is None else r.place, r.fare or 0.0) for r in found) == [
        (1, "s", "SUCCESS", 0, 6120.0), (1, "s", "SUCCESS", 1, 6120.0), (2, "t", "NO_RESULTS", -1, 0.0), (3, "u", "SELECTOR_DRIFT", -1, 0.0), (4, "v", "SUCCESS", 0, 7310.0), (4, "v", "SUCCESS", 0, 7310.0),
    ]
    whole = pages.result_pages(spark.createDataFrame(rows, "page int, h string, fares string"), "h").collect()
    assert sorted((r.page, r.state, [q.fare for q in r.quotes]) for r in whole) == [(1, "SUCCESS", [6120.0, 6120.0]), (2, "NO_RESULTS", []), (3, "SELECTOR_DRIFT", []), (4, "SUCCESS", [7310.0]), (4, "SUCCESS", [7310.0])]
    assert markup.page_quotes(spark.createDataFrame([], "page int, h string"), "h").count() == 0


def test_rpc_blocks():
    lines = "".join(f"<p>line {i}</p>" if i not in (6, 8) else f"<p>₹ {i}00</p>" for i in range(14))
    assert markup.blocks(f"<script>₹1</script>{lines}") == [(6, "\n".join(f"line {i}" if i not in (6, 8) else f"₹ {i}00" for i in range(2, 11))), (8, "\n".join(f"line {i}" if i not in (6, 8) else f"₹ {i}00" for i in range(4, 13)))]
    assert markup.blocks('<li class="pIavfa b"><b>IndiGo</b><i>₹</i>5</li><div class="yR1fYc">no price</div><p>₹ 9</p>') == [(0, "IndiGo\n₹\n5")]
    assert markup.blocks("₹ 1") == [(0, "₹ 1")] and markup.blocks(None) == []


def test_rpc_and_site_quotes(spark):
    page = '<p>IndiGo</p><p>7:05 AM</p><p>9:50 AM</p><p>Nonstop</p><p>₹5,130</p><p>or</p><p>₹4,999</p>' + "<p>-</p>" * 9 + "<p>AIR INDIA EXPRESS</p><p>₹ 640</p>" + "<p>-</p>" * 9 + "<p>SpiceJet</p><p>₹599</p>"
    df = spark.createDataFrame([("p", page, "DEL", "BOM"), ("q", page, "DEL", "BOM"), ("r", None, None, None)], "page string, h string, o string, d string")
    got = sorted((r.page, r.carrier, r.fare, r.dep_time, r.arr_time, r.stops, r.flight, r.band) for r in pages.rpc_quotes(df, "h", "page", "o", "d").collect())
    first = [("AI", 640.0, "09:30 AM", None, 1, "AI-DELBOM-0930AM", "06:00-11:59"), ("6E", 5130.0, "7:05 AM", "9:50 AM", 0, "6E-DELBOM-705AM", "06:00-11:59")]
    assert got == sorted((p, *x) for p in "pq" for x in first)
    texts = ["IndiGo\n6E 234\n08:10\nDirect\n₹4,000", "IndiGo\n6E-234\n08:10\n₹4,000", "Akasa\nQP1402 ₹ 5,000", "SpiceJet ₹599", "None ₹5,000", None]
    cards = spark.createDataFrame([(i, t, "DEL", "BOM") for i, t in enumerate(texts)], "i int, t string, o string, d string").selectExpr("*", "1 AS page")
    got = sorted((r.i, r.carrier, r.flight, r.fare, r.dep_time, r.stops, r.is_surrogate) for r in pages.site_quotes(cards, "t", "skyscanner", "page", "o", "d", "i").collect())
    assert got == [(0, "6E", "6E-234", 4000.0, "08:10", 0, False), (2, "QP", "QP-1402", 5000.0, "12:00", 1, False)]
