"""Small synthetic documents of both formats."""

import io
import struct
import zipfile

from foliospark.sources import binary, compound

HP = "http://www.hancom.co.kr/hwpml/2011/paragraph"
XMLNS = f'xmlns:hp="{HP}" xmlns:hs="http://www.hancom.co.kr/hwpml/2011/section" xmlns:hh="http://www.hancom.co.kr/hwpml/2011/head" xmlns:opf="http://www.idpf.org/2007/opf/" xmlns:hpf="http://www.hancom.co.kr/schema/2011/hpf"'


def p(inner, ref="0"):
    return f'<hp:p id="1" paraPrIDRef="{ref}" styleIDRef="0"><hp:run charPrIDRef="0">{inner}</hp:run></hp:p>'


def t(text):
    return f"<hp:t>{text}</hp:t>"


def cell(r, c, text, rs=1, cs=1):
    return f'<hp:tc><hp:subList><hp:p paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="0">{t(text)}</hp:run></hp:p></hp:subList><hp:cellAddr colAddr="{c}" rowAddr="{r}"/><hp:cellSpan colSpan="{cs}" rowSpan="{rs}"/></hp:tc>'


TABLE = f'<hp:tbl rowCnt="2" colCnt="2"><hp:tr>{cell(0, 0, "a")}{cell(0, 1, "b")}</hp:tr><hp:tr>{cell(1, 0, "c")}{cell(1, 0, "last")}{cell(9, 9, "stray")}</hp:tr></hp:tbl>'
FIELD = '<hp:ctrl><hp:fieldBegin id="7" fieldid="70" type="HYPERLINK" name=""><hp:parameters><hp:stringParam name="Command">http\\://x.org;1;0;</hp:stringParam></hp:parameters></hp:fieldBegin></hp:ctrl>'
END = '<hp:ctrl><hp:fieldEnd beginIDRef="7" fieldid="70"/></hp:ctrl>'
CROSS = '<hp:ctrl><hp:fieldBegin id="8" fieldid="71" type="CROSSREF" name="mark"/></hp:ctrl><hp:ctrl><hp:fieldEnd beginIDRef="8" fieldid="71"/></hp:ctrl>'
CHART = '<hp:switch><hp:case><hp:chart chartIDRef="Chart/chart1.xml"><hp:sz/><hp:pos/><hp:outMargin/></hp:chart></hp:case><hp:default><hp:ole binaryItemIDRef="pic1"><hp:rotationInfo/></hp:ole></hp:default></hp:switch>'
SECTION0 = (
    p('<hp:secPr memoShapeIDRef="0"><hp:pagePr width="100" height="200" landscape="WIDELY"><hp:margin left="5"/></hp:pagePr></hp:secPr>' + t("Title"))
    + p(TABLE)
    + p(FIELD + t("link") + END)
    + p('<hp:ctrl><hp:bookmark name="mark"/></hp:ctrl>' + t("here") + CROSS)
    + p('<hp:ctrl><hp:endNote><hp:subList><hp:p paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="0">' + t("end") + "</hp:run></hp:p></hp:subList></hp:endNote></hp:ctrl>" + t("x") + '<hp:ctrl><hp:footNote><hp:subList/></hp:footNote></hp:ctrl>')
    + p(CHART)
    + p('<hp:pic><hc:img xmlns:hc="http://www.hancom.co.kr/hwpml/2011/core" binaryItemIDRef="pic1"/></hp:pic>')
)
SECTION1 = p(t("")) + p(t("Second &amp; last"))
HEADER = '<hh:head secCnt="2"><hh:styles><hh:style id="0"/></hh:styles><hh:paraPr id="0"/><hh:charPr id="0"/><hh:memoProperties itemCnt="1"><hh:memoPr id="1"/></hh:memoProperties></hh:head>'
HPF = (
    '<opf:package><opf:metadata><opf:title>My title</opf:title><opf:language>ko</opf:language><opf:meta name="creator">A</opf:meta><opf:meta name="creator">B</opf:meta><opf:meta name="other">z</opf:meta></opf:metadata>'
    '<opf:manifest><opf:item id="header" href="Contents/header.xml" media-type="application/xml"/><opf:item id="s0" href="Contents/section0.xml" media-type="application/xml"/><opf:item id="s1" href="Contents/section10.xml" media-type="application/xml"/>'
    '<opf:item id="pic1" href="BinData/pic1.png" media-type="image/png"/><opf:item id="c1" href="Chart/chart1.xml" media-type="application/xml"/></opf:manifest><opf:spine><opf:itemref idref="s0"/><opf:itemref idref="s1"/></opf:spine></opf:package>'
)


def xml(body):
    """A part: the namespaces go into the first tag."""
    i = min(x for x in (body.find(" "), body.find(">"), body.find("/>")) if x > 0)
    return f'<?xml version="1.0" encoding="UTF-8"?>{body[:i]} {XMLNS}{body[i:]}'.encode()


def parts(**changes):
    out = {
        "mimetype": b"application/hwp+zip", "version.xml": b"<HCFVersion/>", "Contents/content.hpf": xml(HPF), "Contents/header.xml": xml(HEADER), "Contents/section0.xml": xml(f"<hs:sec>{SECTION0}</hs:sec>"),
        "Contents/section10.xml": xml(f"<hs:sec>{SECTION1}</hs:sec>"), "META-INF/container.xml": b'<container><rootfiles><rootfile full-path="Contents/content.hpf"/><rootfile full-path="Preview/PrvText.txt"/></rootfiles></container>',
        "BinData/pic1.png": b"\x89PNG", "Chart/chart1.xml": b"<chart/>",
    }
    out |= {k: v for k, v in changes.items() if v is not None}
    return {k: v for k, v in out.items() if changes.get(k, 1) is not None}


def package(members=None, extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, raw in [*(members or parts()).items(), *extra]:
            z.writestr(zipfile.ZipInfo(name), raw, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def u16(text):
    return struct.pack("<H", len(text.encode("utf-16-le")) // 2) + text.encode("utf-16-le")


T = binary.TAGS


def docinfo(shapes=1, styles=1):
    counts = [0] * 18
    counts[0], counts[13], counts[14] = 1, shapes, styles
    r = binary.record_bytes
    out = r(T["document_properties"], 0, struct.pack("<7H3I", 2, 1, 1, 1, 1, 1, 1, 0, 0, 0)) + r(T["id_mappings"], 0, struct.pack("<18I", *counts))
    out += r(T["bin_data"], 0, struct.pack("<HH", 1, 1) + u16("png")) + r(T["face_name"], 0, bytes([0x80]) + u16("Font"))
    return out + r(T["para_shape"], 0, b"\0" * 54) + r(T["style"], 0, u16("바탕글") + u16("Normal") + struct.pack("<5H", 0, 1042, 0, 3, 4))


def section(texts, more=b""):
    r = binary.record_bytes
    out = b""
    for x in texts:
        out += r(T["para_header"], 0, struct.pack("<IIHBB", len(x) + 1, 0, 0, 0, 0)) + r(T["para_text"], 1, x.encode("utf-16-le") + b"\r\0")
    return out + more


def table(text):
    r = binary.record_bytes
    head = r(T["para_header"], 0, struct.pack("<IIHBB", 9, 0, 0, 0, 0))
    control = struct.pack("<8H", 11, *struct.unpack("<2H", b" lbt"), 0, 0, 0, 0, 11)
    head += r(T["para_text"], 1, "a".encode("utf-16-le") + control + "b\U0001f600".encode("utf-16-le"))
    head += r(T["ctrl_header"], 1, b" lbt" + b"\0" * 8) + r(T["table"], 2, b"\0" * 20) + r(T["list_header"], 2, b"\0" * 6)
    return head + r(T["para_header"], 2, struct.pack("<IIHBB", 2, 0, 0, 0, 0)) + r(T["para_text"], 3, text.encode("utf-16-le"))


def picture(kind="picture", size=73):
    r = binary.record_bytes
    return r(T["para_header"], 0, b"\0" * 12) + r(T["ctrl_header"], 1, b" osg" + b"\0" * 40) + r(T["shape_component"], 2, b"\0" * 30) + r(T[kind], 3, b"\0" * size)


def compound_file(compressed=True, sections=None, **changes):
    sections = sections or [section(["hello", "wo\nrld"], table("cell") + picture()), section(["second"], picture("line"))]
    pack = binary.deflate if compressed else bytes
    streams = {"FileHeader": (binary.SIGNATURE.encode().ljust(32, b"\0") + bytes([1, 0, 1, 5]) + struct.pack("<I", int(compressed))).ljust(256, b"\0"), "DocInfo": pack(changes.pop("docinfo", docinfo())), "BinData/BIN0001.png": b"\x89PNG" * 2000, "PrvText": "prev".encode("utf-16-le")}
    streams |= {f"BodyText/Section{i}": pack(s) for i, s in enumerate(sections)}
    streams |= changes
    return compound.write(streams)
