"""Lines without sentence marks, menus and link lists."""

import pytest

from hitscope.llm import quality

PROSE = " ".join(f"The hill{i} was green and the river{i} ran below{i} it, as it{i} had." for i in range(6))


@pytest.mark.parametrize("lines, fails", [
    (["red green blue house stone river " * 5], True), (["Home About News Contact Help"], True), (["Home", "About us", "", "News", "Contact", "Help"], True),
    (["Über Uns Ähnlich Öffnung Übersicht"], True), (["Chapter one of the long story"], False), (["roses are red", "violets are blue"], False),
    (["12.5 33.1 2019"] * 6, False), (["\u0939\u093f\u0928\u094d\u0926\u0940 \u0939\u0948 " * 15], False), (["one, two, three,", "four, five,", "six,", "seven,", "eight,"], False)])
def test_bare_lines(spark, lines, fails):
    row = quality.clean_lines(spark.createDataFrame([(1, "\n".join([PROSE, *lines, PROSE]))], "doc_id int, text string")).first()
    assert row["n_failed_lines"] == (sum(bool(x) for x in lines) if fails else 0)


def test_menu_pages_are_rejected(spark):
    page = "\n".join(f"Link to page{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    assert not quality.verdicts(spark.createDataFrame([(1, page)], "doc_id int, text string")).where("kept and not base_failed").count()
    assert quality.verdicts(spark.createDataFrame([(1, page)], "doc_id int, text string")).first()["n_failed_lines"] == 80
