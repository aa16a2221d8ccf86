"""Schemas of the normalised document tables. A cell's nested blocks are addressed by path, never by nested structs."""

from pyspark.sql import types as T

_parse = T._parse_datatype_string

PATH = "array<struct<block:int,row:int,col:int>>"

DOC = _parse("doc_id string, origin string, n_sections int")
SECTION = _parse("doc_id string, section int, width int, height int, margin_left int, margin_right int, margin_top int, margin_bottom int, page_edited boolean")
BLOCK = _parse(f"doc_id string, section int, path {PATH}, block int, kind string, container string, dirty boolean")
PARAGRAPH = _parse(f"doc_id string, section int, path {PATH}, block int, node_id long, para_ref string, char_ref string, simple boolean, page_break_before boolean, style_name string, text string")
RUN = _parse(f"doc_id string, section int, path {PATH}, block int, run int, char_shape int, char_ref string, text string")
TABLE = _parse(f"doc_id string, section int, path {PATH}, block int, rows int, cols int, col_widths array<int>, row_heights array<int>, stored_row_heights array<int>")
CELL = _parse(f"doc_id string, section int, path {PATH}, block int, row int, col int, row_span int, col_span int, active boolean, shade string, text string")
CHAR_SHAPE = _parse("doc_id string, xml_id long, height int, bold boolean, italic boolean, color string, font string")
PARA_SHAPE = _parse("doc_id string, xml_id long, align string, line_spacing_type string, line_spacing_value int, page_break_before boolean")
PLACED_BLOCK = _parse("doc_id string, page int, section int, block int, kind string, x double, y double, w double, h double")
PLACED_CELL = _parse("doc_id string, page int, table_ord int, row int, col int, x double, y double, w double, h double")
OP_LOG = _parse("doc_id string, rev long, seq int, op string, args string")
