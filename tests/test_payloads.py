import random
import struct

import pytest
from fixtures import compound_file
from pyspark.sql import functions as F

from foliospark.sources import binary as B
from foliospark.sources import payloads as P

ALL = P.DECODERS | P.CONTROL_DECODERS | P.ID_DECODERS | {"line_info": P.line_info, "endnote_shape": lambda p: P.note_shape(p, True)}


def one(spark, fields, raw):
    df = spark.createDataFrame([(bytearray(raw),)], "payload binary")
    return df.select(P.struct(fields(F.col("payload"))).alias("r")).first().r.asDict(recursive=True)


def u16(text):
    raw = text.encode("utf-16-le")
    return struct.pack("<H", len(raw) // 2) + raw


#: One name a decoder.
NAMES = {f: n for n, f in ALL.items()}


@pytest.mark.parametrize("name", sorted(NAMES.values()))
def test_any_length(spark, name):
    """No payload breaks a decoder: null, empty, cut off anywhere, random."""
    rnd = random.Random(name)
    rows = [(None,), (b"",)] + [(rnd.randbytes(n),) for n in [*range(1, 80, 3), 202, 217, 300]] + [(b"\xff" * n,) for n in (8, 33, 64)]
    df = spark.createDataFrame([(r[0] and bytearray(r[0]),) if r[0] != b"" else (bytearray(),) for r in rows], "payload binary")
    assert len(df.select(P.struct(ALL[name](F.col("payload"))).alias("r")).collect()) == len(rows)


def test_lone_surrogates(spark):
    units = [0x61, 0xD83D, 0xDE00, 0xD800, 0x62, 0xDC01, 0xDD61, 0xD8D8, 0x63, 0xDBFF]
    raw = struct.pack(f"<{len(units)}H", *units)
    assert spark.createDataFrame([(bytearray(raw),)], "p binary").select(P.utf16(F.col("p"))).first()[0] == raw.decode("utf-16-le", "ignore") == "a\U0001f600bc"


def test_integers(spark):
    raw = bytes(range(250, 256)) + b"\x01\x80"
    df = spark.createDataFrame([(bytearray(raw),)], "p binary")
    got = df.select(P.signed(F.col("p"), 6, 2), P.signed(F.col("p"), 2, 4), P.numbers(F.col("p"), 2), P.signed(F.col("p"), 6, 4), P.flags(F.lit(5), 4)).first()
    assert tuple(got) == (-32767, struct.unpack("<i", raw[2:6])[0], list(struct.unpack("<4H", raw)), None, [True, False, True, False])


def test_fonts(spark):
    raw = bytes([0xE0]) + u16("Batang") + b"\x02" + u16("Sub") + bytes(range(10)) + u16("Def") + b"zz"
    got = one(spark, P.face_name, raw)
    assert (got["name"], got["substitute_font_type"], got["substitute_font_name"], got["default_font_name"], bytes(got["tail"])) == ("Batang", 2, "Sub", "Def", b"zz")
    assert list(got["font_information"].values()) == list(range(10))
    got = one(spark, P.face_name, b"\0" + u16("A"))
    assert got["name"] == "A" and got["substitute_font_name"] is None and got["tail"] is None


def test_shapes_of_text(spark):
    raw = struct.pack("<7H7B7b7B7bII2hI", *range(7), *range(100, 107), *range(-7, 0), *range(7), *range(-3, 4), 1000, 1 << 15 | 1 << 30, -5, 6, 0x112233) + b"\0\0" + struct.pack("<III", 0xFFFFFFFF, 1, 9)
    got = one(spark, P.char_shape, raw)
    assert list(got["font_refs"].values()) == list(range(7)) and list(got["spacings"].values()) == list(range(-7, 0)) and list(got["position_offsets"].values()) == list(range(-3, 4))
    assert (got["base_size"], got["shadow_offset"], got["text_color"], got["shade_color"], got["shadow_color"], got["border_fill_id"]) == (1000, {"x": -5, "y": 6}, "#112233", "none", "#000001", 9)
    assert got["superscript"] and got["use_kerning"] and not got["emboss"] and got["tail"] is None
    raw = struct.pack("<I6i3H4HIIi", 3 | 1 << 9 | 1 << 15, -1, 2, 3, 4, 5, 160, 7, 8, 9, 1, 2, 3, 4, 11, 12, 130)
    got = one(spark, P.para_shape, raw)
    assert (got["alignment"], got["margins"]["intent"], got["line_spacing_primary"], got["line_spacing"], got["tab_def_id"], got["heading_type"]) == ("CENTER", -1, 160, 130, 7, "NUMBER")
    assert got["widow_orphan"] and got["line_wrap_squeeze"] and not got["keep_lines"] and list(got["border_offsets"].values()) == [1, 2, 3, 4]
    assert one(spark, P.para_shape, raw[:30])["line_spacing"] == 160


def test_lists(spark):
    levels = [(i, -i, i + 1, -1 if i == 2 else i, f"^{i}.") for i in range(7)]
    raw = b"".join(struct.pack("<IhhI", a, b, c, d & 0xFFFFFFFF) + u16(t) for a, b, c, d, t in levels) + struct.pack("<H3I", 5, 1, 2, 3) + b"x"
    got = one(spark, P.numbering, raw)
    assert [(v["para_head"], v["width_adjust"], v["text_offset"], -1 if v["char_pr_id"] is None else v["char_pr_id"], v["format"]) for v in got["levels"]] == levels
    assert (got["unknown_short"], got["start_numbers"], bytes(got["tail"])) == (5, [1, 2, 3], b"x")
    assert one(spark, P.numbering, b"")["levels"] == []
    tabs = struct.pack("<II", 2, 9) + struct.pack("<iBBH", -8, 2, 3, 1) + struct.pack("<iBBH", 4, 9, 9, 0) + b"end"
    got = one(spark, P.tab_def, tabs)
    assert [(t["position"], t["tab_type_name"], t["leader_type_name"]) for t in got["tabs"]] == [(-8, "CENTER", "DASH"), (4, "CODE_9", "CODE_9")] and got["auto_tab_right"] and bytes(got["tail"]) == b"end"
    assert one(spark, P.tab_def, struct.pack("<II", 1, 0))["tabs"] == []
    got = one(spark, P.bullet, struct.pack("<Ihhi", 1, -2, 3, -1) + "●".encode("utf-16-le"))
    assert (got["width_adjust"], got["char_pr_id"], got["bullet_char"], got["flag_bits"][0]) == (-2, None, "●", True)


def test_drawing(spark):
    got = one(spark, P.polygon, struct.pack("<H6i", 3, 1, 2, 3, -1, -2, -3) + b"t")
    assert got["points"] == [{"x": 1, "y": -1}, {"x": 2, "y": -2}, {"x": 3, "y": -3}] and bytes(got["tail"]) == b"t"
    assert one(spark, P.polygon, struct.pack("<H4i", 3, 1, 2, 3, 9))["points"] == [{"x": 1, "y": 9}] and one(spark, P.polygon, b"")["points"] == []
    assert one(spark, P.line, struct.pack("<4iI", 1, -2, 3, 4, 7)) | {"u16_values": 0, "u32_values": 0} == {"start": {"x": 1, "y": -2}, "end": {"x": 3, "y": 4}, "attributes": 7, "u16_values": 0, "u32_values": 0}
    assert one(spark, P.ellipse, struct.pack("<15i", *range(15)))["end_2"] == {"x": 13, "y": 14}
    got = one(spark, P.line_info, struct.pack("<IHIB", 0x0000FF, 5, 1 << 6 | 4 << 22 | 1 << 31, 2))
    assert (got["color"], got["width"], got["outline_style"]) == ("#0000FF", 5, "INNER")
    f = got["attribute_flags"]
    assert (f["line_style"], f["end_cap"], f["head_size"], f["tail_size"], f["head_fill"], f["tail_fill"]) == ("SOLID", "FLAT", "MEDIUM_MEDIUM", "SMALL_SMALL", False, True)
    raw = bytearray(217)
    raw[28:36], raw[40:50] = struct.pack("<2I", 100, 60), struct.pack("<H2i", 90, 50, 30)
    assert one(spark, P.shape_component, raw)["angle"] == 90 and one(spark, P.shape_component, raw)["center"] is None
    raw[42:46] = struct.pack("<i", 7)
    assert one(spark, P.shape_component, raw)["center"] == {"x": 7, "y": 30}
    assert one(spark, P.shape_component, P.CONNECT_LINE + bytes(30))["is_connect_line"]
    assert one(spark, P.textart, bytes(32) + u16("a\rb"))["text"] == "ab" and one(spark, P.textart, bytes(32) + b"\x09\0a")["text"] == ""
    raw = bytearray(91)
    raw[28:36], raw[44:60] = struct.pack("<2I", 10, 20), struct.pack("<4I", 0, 0, 10, 20)
    assert one(spark, P.picture, raw) == {"crop": None, "adjustment": None}
    raw[44], raw[70] = 1, 1
    assert one(spark, P.picture, raw)["crop"]["left"] == 1 and one(spark, P.picture, raw)["adjustment"]["effect"] == "GRAY_SCALE"


def test_fill(spark):
    side = struct.pack("<BBI", 0, 3, 0x0A0B0C)
    raw = struct.pack("<H", 1 | 5 << 2) + side * 5 + struct.pack("<H", 1) + struct.pack("<IIIIB", 1, 0x102030, 2, 3, 4)
    got = one(spark, P.border_fill, raw)
    assert got["three_d"] and got["slash"] == 5 and got["diagonal"] == {"style_code": 0, "width_code": 3, "color": "#0A0B0C", "style": "SOLID"}
    assert (got["fill"]["face_color"], got["fill"]["pattern_alpha"], got["color_pattern"]) == ("#102030", 4, True)


def test_section_parts(spark):
    assert list(one(spark, P.page_def, struct.pack("<10I", *range(1, 11))).values()) == list(range(1, 10))
    got = one(spark, P.page_border_fill, struct.pack("<I5H", 1 | 4, 1, 2, 3, 4, 5))
    assert got == {"text_border": "PAPER", "header_inside": False, "footer_inside": True, "fill_area": "PAPER", "left": 1, "right": 2, "top": 3, "bottom": 4, "border_fill_id": 5}
    raw = struct.pack("<I", 2 | 1 << 8 | 2 << 10 | 1 << 13) + "*\0)".encode("utf-16-le") + struct.pack("<HhHHHBBI", 4, -1, 850, 567, 283, 2, 0, 0x010203)
    got = one(spark, P.note_shape, raw)
    assert (got["number_type"], got["user_char"], got["prefix_char"], got["suffix_char"], got["numbering"], got["new_number"], got["line_length"]) == ("ROMAN_CAPITAL", "*", "", ")", "ON_PAGE", 4, -1)
    assert (got["line_type"], got["line_width"], got["line_color"], got["place"], got["beneath_text"], got["between_notes"]) == ("DOT", "0.1 mm", "#010203", "MERGED_COLUMN", True, 283)
    assert one(spark, ALL["endnote_shape"], raw)["line_length"] == 65535
    got = one(spark, P.page_number, b"pngp" + struct.pack("<I", 1 | 6 << 8) + "\0\0\0=".encode("utf-16-le"))
    assert got == {"position": "BOTTOM_RIGHT", "format": "CIRCLED_DIGIT", "side_char": "="}
    assert one(spark, P.page_hiding, b"dhgp\x09\0\0\0")["border"] and one(spark, P.page_starts_on, b"tcgp\x02\0\0\0") == {"starts_on": "ODD"}
    assert one(spark, P.header_footer, b"daeh\x01\0\0\0") == {"apply_page_type": "EVEN"} and one(spark, P.header_footer, b"daeh") == {"apply_page_type": "BOTH"}
    got = one(spark, P.section_definition, b"dces" + struct.pack("<IHHHI6H", 1 | 1 << 19, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10))
    assert (got["tab_stop"], got["page"], got["language"], got["hide_first_header"], got["hide_first_empty_line"], got["hide_first_footer"]) == (4, 6, 10, True, True, False)


def test_controls(spark):
    raw = bytearray(46) + "abc".encode("utf-16-le")
    raw[4:8], raw[8:16], raw[28:36], raw[44] = bytes([0x31, 0x0A, 0x20, 2]), struct.pack("<2i", -3, 4), struct.pack("<4H", 1, 2, 3, 4), 2
    got = one(spark, P.graphic, raw)
    assert got["layout"] == {
        "text_wrap": "TOP_AND_BOTTOM", "text_flow": "RIGHT_ONLY", "treat_as_char": True, "vert_rel_to": "PARA", "horz_rel_to": "COLUMN", "vert_align": "CENTER", "horz_align": "RIGHT",
        "vert_offset": -3, "horz_offset": 4,
    } and got["margins"] == {"left": 1, "right": 2, "top": 3, "bottom": 4} and got["description"] == "ab"
    assert one(spark, P.bookmark_data, bytes(10) + u16("spot"))["name"] == "spot" and one(spark, P.hyperlink_command, bytes(9) + u16("http"))["command"] == "http"
    got = one(spark, P.memo_shape, "X_META;width=7;lineWidth=q;lineColor=#010203".encode("utf-16-le"))
    assert (got["width"], got["line_width"], got["line_color"]) == (7, None, "#010203")
    assert one(spark, P.track_change_author, u16("Kim") + b"!")["name"] == "Kim" and one(spark, P.list_header, struct.pack("<II", 2, 1))["paragraph_count"] == 2


def test_decode_file(spark):
    rows = B.records(B.streams(spark.createDataFrame([("a", bytearray(compound_file()))], "doc string, content binary"))).cache()
    assert P.decode(rows, "para_shape").count() == rows.where(B.tag("para_shape")).count() > 0
    assert P.decode_controls(B.controls(rows), "picture").columns[-3:] == ["layout", "margins", "description"]
