import pytest

from passagelake.operators import layout
from passagelake.sources import files, spans

SCHEMA = "source string, page_idx int, block_no int, line_no int, text string, size double, bold boolean, font string, x0 double, y0 double, x1 double, y1 double"


class Page:
    def __init__(self, source="pilot"):
        self.rows, self.source, self.page, self.block, self.y = [], source, -1, 0, 0.0

    def new(self, unit, n):
        self.page += 1
        self.block, self.y = 0, 150.0
        return self

    def add(self, *lines, size=10.0, bold=False, font="Arial", x=50.0, y=None):
        if y is not None:
            self.y = y
        for i, text in enumerate(lines):
            at = x[i] if isinstance(x, list) else x
            self.rows.append((self.source, self.page, self.block, i, text, size, bold, font, at, self.y, at + 40, self.y + 10))
            self.y += 12
        self.block += 1
        self.y += 8
        return self

    def foot(self, text):
        return self.add("Revision 1.0", text, size=8.0, y=800.0)


def frames(spark, page, boxes=()):
    return spark.createDataFrame(page.rows, SCHEMA), spark.createDataFrame(list(boxes), "source string, page_idx int, box_no int, x0 double, y0 double, x1 double, y1 double")


def render(spark, page, unit, boxes=()):
    lines, ruled = frames(spark, page, boxes)
    wanted = spark.createDataFrame([(page.source, unit)], "source string, unit_id string")
    return layout.render_units(lines, ruled, wanted).first()


def test_a_unit(spark):
    p = Page().new(5, 1).add("Unit 5 - Primary effects", size=14.0).add("KEY MESSAGES", size=14.0, bold=True).add("Some prose", "that wraps.").add("•", "an item", "wraps").add("• inline").add("o", "nested").foot("Page 5 - 1")
    p.new(5, 2).add("THREAT AND ERROR", "MANAGEMENT", size=14.0, bold=True).add("Suggested Patter:", bold=True).add("Say this.").add("1.").add("bare").foot("Page 5 - 2")
    got = render(spark, p, "5")
    assert got.error is None
    assert got.content == (
        '---\nsource: pilot\nunit: 5\nunit_name: Primary effects\nrevision: "1.0"\n---\n\n# Unit 5 — Primary effects\n\n<!-- page: 5-1 -->\n\n## KEY MESSAGES\n<!-- content_type: key_messages -->\n\n'
        "Some prose that wraps.\n\n- an item wraps\n- inline\n  - nested\n<!-- page: 5-2 -->\n\n## THREAT AND ERROR MANAGEMENT\n<!-- content_type: airmanship -->\n\n#### Suggested Patter\n<!-- content_type: reference_patter -->\n\nSay this.\n\n1.\n\nbare\n"
    )


def test_reading_order_goes_down_then_right(spark):
    p = Page().new(5, 1).add("Unit 5 - X", size=14.0).add("lower", y=400.0).add("upper", y=300.0).add("right", y=300.2, x=200.0).add("KEY MESSAGES", size=14.0, bold=True, y=200.0).foot("Page 5 - 1")
    body = render(spark, p, "5").content.split("-->")[-1].split()
    assert body == ["upper", "right", "lower"]


def test_a_numbered_heading_and_joined_headings(spark):
    p = Page("trainer").new(5, 1).add("Unit 5 - X", size=14.0).add("1.", "Awareness", bold=True).add("AIM", "KEY MESSAGES", size=14.0, bold=True).foot("Page 5 - 1")
    p.rows = [(*r[:6], False, *r[7:]) if r[4] == "1." else r for r in p.rows]
    text = render(spark, p, "5").content
    assert "### 1. Awareness" in text and "## AIM\n<!-- content_type: aim -->\n\n## KEY MESSAGES" in text


def test_an_unmapped_section_is_an_error(spark):
    p = Page().new(5, 1).add("Unit 5 - X", size=14.0).add("NOT A HEADER", size=14.0, bold=True).foot("Page 5 - 1")
    got = render(spark, p, "5")
    assert got.content is None and "NOT A HEADER" in got.error


@pytest.mark.parametrize(
    "feet, unit, ok",
    [(["Page 7 - 1", "Page 7 - 3"], "7", False), (["Page 7 - 1", "Page 7 - 2", "Page 7 - 3"], "7", True), (["nothing", "Page 7 - 2"], "7", True), (["Page 13A - 1"], "13", False), (["Page 13A - 1"], "13A", True), (["Page 7 - 1"], "8", False), (["Page 7 - 1"], "x", False)],
)
def test_page_runs(spark, feet, unit, ok):
    p = Page()
    for i, f in enumerate(feet):
        p.new(7, i).add("Unit 7 - X", size=14.0).foot(f)
    lines, _ = frames(spark, p)
    wanted = spark.createDataFrame([("pilot", unit)], "source string, unit_id string")
    got = layout.page_runs(layout.footers(lines), wanted).first()
    assert (got.error is None) == ok


def test_a_wrong_footer_needs_its_header(spark):
    right = Page().new(38, 1).add("Unit 38 – Weather", size=11.0).foot("Page 37 - 1")
    wrong = Page().new(37, 1).add("Unit 37 – Other", size=11.0).foot("Page 37 - 1")
    assert layout.footers(frames(spark, right)[0]).first().unit == 38
    assert layout.footers(frames(spark, wrong)[0]).first().unit == 37


def test_a_two_column_table(spark):
    p = Page("trainer").new(5, 1).add("Unit 5 - X", size=14.0).add("COMMON PROBLEMS", size=14.0, bold=True, y=180.0)
    p.add("Problem", "Probable Cause", x=[50.0, 300.0], y=210.0)
    p.add("Too fast", y=240.0).add("● nose low", "too far", x=300.0, y=240.0).add("Too slow", y=280.0).add("and wobbly", y=291.0).add("Plain cause", x=300.0, y=300.0)
    p.foot("Page 5 - 1")
    box = [("trainer", 0, 0, 40.0, 205.0, 500.0, 330.0), ("trainer", 0, 1, 45.0, 230.0, 400.0, 300.0)]
    text = render(spark, p, "5", box).content
    assert text.endswith("## COMMON PROBLEMS\n<!-- content_type: common_problems -->\n\n### Too fast\n\n- nose low too far\n\n### Too slow and wobbly\n\nPlain cause\n")


def test_spans_make_lines(spark):
    rows = [("s", 0, 0, 0, 0, " ", 99.0, False, "A"), ("s", 0, 0, 0, 1, "Bold", 10.04, True, "B"), ("s", 0, 0, 0, 2, " too ", 12.06, True, "C"), ("s", 0, 0, 1, 0, "  ", 9.0, False, "A")]
    df = spark.createDataFrame([(*r, 0.0, 0.0, 1.0, 1.0) for r in rows], "source string, page_idx int, block_no int, line_no int, span_no int, text string, size double, bold boolean, font string, x0 double, y0 double, x1 double, y1 double")
    got = spans.lines_of(df).collect()
    assert len(got) == 1 and (got[0].text, got[0].size, got[0].bold, got[0].font) == ("Bold too", 12.1, True, "B")


def test_a_tree_is_written_and_read(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.createDataFrame([("pilot", "5", "a\n", None), ("pilot", "13A", "b — é\n", None), ("pilot", "6", None, "gap")], "source string, unit_id string, content string, error string")
    out = files.write_markdown_tree(df, root)
    written, skipped = files.report(out.cache())
    assert {r.path for r in written.collect()} == {"pilot/unit-05.md", "pilot/unit-13A.md"} and skipped.first().unit_id == "6"
    assert {r.path.rsplit("/", 1)[1]: r.content for r in files.read_markdown_tree(spark, root).collect()} == {"unit-05.md": "a\n", "unit-13A.md": "b — é\n"}


def test_the_lines_of_tables_are_worked_out_once(spark):
    """Regions and elements are read off written rows: neither goes back to the lines."""
    from passagelake.plans import booklets

    folder = "/root/testdata/sf0.001"
    regions, elements = layout.table_regions(booklets._marked(spark, folder), booklets._boxes(spark, folder))
    for out in (regions, elements):
        files = out.inputFiles()
        assert files and all("layout-" in f for f in files) and not any("supplier" in f for f in files)
    assert regions.count() == elements.select("source", "page_idx", "box_no").distinct().count() > 0
