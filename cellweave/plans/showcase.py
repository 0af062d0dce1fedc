"""One workbook a nation in which every kind of part occurs, by format: what the queries of looks and parts scan."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.plans.fixtures import compound, table

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DRAW = 'xmlns:xdr="urn:xdr" xmlns:a="urn:a" xmlns:r="urn:r" xmlns:c="urn:c"'


def _rels(*items: tuple[str, str, str]) -> str:
    def one(rid: str, kind: str, target: str) -> str:
        outside = ' TargetMode="External"' if "://" in target else ""
        return f'<Relationship Id="{rid}" Type="{REL}/{kind}" Target="{target}"{outside}/>'

    return f'<?xml version="1.0"?><Relationships xmlns="urn:rels">{"".join(one(*i) for i in items)}</Relationships>'


def xlsx(k: int, name: str) -> bytes:
    """k: the nation's key; name: its name, which stands in texts that look like markup."""
    styles = f"""<?xml version="1.0"?><styleSheet {MAIN}><numFmts count="1"><numFmt numFmtId="164" formatCode="0.000 &quot;k&quot;"/></numFmts>
<fonts><font><sz val="11"/><name val="Calibri"/></font><font><b/><i val="0"/><u/><sz val="{10 + k}"/><color rgb="FFAA00{k:02X}"/><name val="Arial"/></font><font><i/><strike/><sz val="9"/><color theme="4"/><name val="Cambria"/></font></fonts>
<fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF00FF00"/></patternFill></fill><fill><patternFill patternType="solid"><fgColor indexed="13"/></patternFill></fill></fills>
<borders><border><left/></border><border><left style="thin"><color rgb="FF0000FF"/></left><right style="medium"><color theme="1"/></right><top/><bottom style="double"/></border></borders>
<cellXfs><xf numFmtId="0" fontId="0"/><xf numFmtId="164" fontId="1" fillId="2" borderId="1"><alignment horizontal="center" vertical="center" wrapText="1"/></xf><xf numFmtId="14" fontId="2" fillId="3" borderId="0"><alignment vertical="top"/></xf></cellXfs>
<dxfs><dxf><font><b/><color rgb="FFFF0000"/></font><fill><patternFill><bgColor rgb="FFFFFF00"/></patternFill></fill><border><left style="thin"><color rgb="FF00FF00"/></left></border></dxf></dxfs></styleSheet>"""
    sheet = f"""<?xml version="1.0"?><worksheet {MAIN}><dimension ref="A1:E{k + 5}"/><sheetViews><sheetView showGridLines="0" topLeftCell="B3"><pane xSplit="1" ySplit="2" topLeftCell="C5" state="frozen"/></sheetView></sheetViews>
<cols><col min="1" max="2" width="10"/><col min="4" max="4" width="{k + 1}" hidden="1"/></cols><sheetData>
<row r="1" ht="30.5"><c r="A1" s="1" t="s"><v>0</v></c><c r="B1" s="1"><v>{k}</v></c></row>
<row r="2" hidden="1"><c r="A2" s="2" t="b"><v>1</v></c><c r="B2" t="e"><v>#DIV/0!</v></c><c r="C2" t="str"><f>SUMPRODUCT( A:A=B:B)</f><v>x</v></c><c r="D2" t="inlineStr"><is><r><t>use xmlns="q" </t></r><r><t>here</t></r></is></c></row>
<row r="4"><c r="A4"><v>0</v></c></row></sheetData><sheetProtection sheet="1"/><protectedRanges><protectedRange sqref="A1:B1 D4" name="p"/></protectedRanges><mergeCells><mergeCell ref="A1:B2"/><mergeCell ref="D1:D{k + 2}"/></mergeCells>
<conditionalFormatting sqref="A1:A9"><cfRule type="cellIs" dxfId="0" priority="1" operator="between"><formula>{k}</formula><formula>9.5</formula></cfRule><cfRule type="containsText" priority="2" operator="containsText" text="abc"/></conditionalFormatting>
<conditionalFormatting sqref="B1"><cfRule type="expression" priority="3"><formula>_xlfn.ISEVEN(A1)</formula></cfRule><cfRule type="dataBar" priority="4"/><cfRule type="containsBlanks" dxfId="0" priority="5"/><cfRule type="top10" priority="6"/><cfRule type="cellIs" operator="equal" priority="7"><formula>"t"</formula></cfRule></conditionalFormatting>
<dataValidations><dataValidation type="list" sqref="A1" allowBlank="1"><formula1>"a, b,c"</formula1></dataValidation><dataValidation type="whole" operator="greaterThan" errorStyle="warning" sqref="B1:B9"><formula1>{k}</formula1></dataValidation></dataValidations>
<hyperlinks><hyperlink ref="A1" r:id="rId1"/><hyperlink ref="B1" location="Hid!A1"/></hyperlinks><drawing r:id="rId3"/></worksheet>"""
    comments = f'<comments {MAIN}><authors><author>me</author></authors><commentList><comment ref="B{k + 1}" authorId="0"><text><r><t>{name} </t></r><r><t>a:b=1</t></r></text></comment><comment ref="C1"><text/></comment></commentList></comments>'
    at = "<xdr:from><xdr:col>{0}</xdr:col><xdr:colOff>9525</xdr:colOff><xdr:row>{1}</xdr:row><xdr:rowOff>19050</xdr:rowOff></xdr:from><xdr:to><xdr:col>{2}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{3}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:to>"
    drawing = f"""<xdr:wsDr {DRAW}><xdr:twoCellAnchor>{at.format(1, 2, 3, 7)}<xdr:pic><xdr:blipFill><a:blip r:embed="rId1"/></xdr:blipFill></xdr:pic></xdr:twoCellAnchor>
<xdr:twoCellAnchor>{at.format(k, 0, k + 1, 1)}<xdr:sp><xdr:spPr><a:prstGeom prst="ellipse"/><a:solidFill><a:srgbClr val="1234{k:02X}"/></a:solidFill><a:ln w="19050"><a:solidFill><a:schemeClr val="accent2"/></a:solidFill></a:ln></xdr:spPr>
<xdr:txBody><a:p><a:r><a:rPr><a:solidFill><a:schemeClr val="odd"/></a:solidFill></a:rPr><a:t>{name}</a:t></a:r><a:r><a:t>!</a:t></a:r></a:p><a:p/><a:p><a:r><a:t>two</a:t></a:r></a:p></xdr:txBody></xdr:sp></xdr:twoCellAnchor>
<xdr:twoCellAnchor>{at.format(0, 0, 1, 1)}<xdr:graphicFrame><xdr:xfrm><a:off x="95250" y="190500"/><a:ext cx="952500" cy="476250"/></xdr:xfrm><a:graphic><a:graphicData><c:chart r:id="rId2"/></a:graphicData></a:graphic></xdr:graphicFrame></xdr:twoCellAnchor></xdr:wsDr>"""
    title = "<c:title><c:tx><c:rich><a:p><a:r><a:t>{0}</a:t></a:r></a:p></c:rich></c:tx></c:title>"
    series = "<c:ser><c:spPr><a:solidFill><a:srgbClr val=\"AABBCC\"/></a:solidFill></c:spPr><c:cat><c:strRef><c:f>Main!$A$2:$A$9</c:f></c:strRef></c:cat><c:val><c:numRef><c:f>{0}</c:f></c:numRef></c:val></c:ser>"
    chart = f"""<c:chartSpace {DRAW}><c:chart>{title.format(name)}<c:plotArea><c:lineChart>{series.format("Main!$C$2:$C$9")}{series.format(f"Main!$E$2:$E${k + 9}")}</c:lineChart>
<c:catAx><c:delete val="1"/>{title.format("base")}</c:catAx><c:valAx><c:scaling><c:orientation val="maxMin"/><c:max val="{k}.5"/></c:scaling></c:valAx></c:plotArea><c:legend><c:legendPos val="b"/></c:legend></c:chart></c:chartSpace>"""
    files = {
        "xl/workbook.xml": f'<?xml version="1.0"?><workbook {MAIN}><sheets><sheet name="Main" sheetId="1" r:id="rId2"/><sheet name="Hid" sheetId="2" state="hidden" r:id="rId1"/></sheets><definedNames><definedName name="_xlnm.Print_Area">Main!$A$1:$B${k + 1}</definedName></definedNames></workbook>',
        "xl/_rels/workbook.xml.rels": _rels(("rId1", "worksheet", "worksheets/b.xml"), ("rId2", "worksheet", "/xl/worksheets/a.xml")),
        "xl/sharedStrings.xml": f"<sst {MAIN}><si><t>{name} ratio x:y=3</t></si></sst>", "xl/styles.xml": styles, "xl/worksheets/a.xml": sheet,
        "xl/worksheets/b.xml": f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1"><v>7</v></c></row></sheetData></worksheet>',
        "xl/worksheets/_rels/a.xml.rels": _rels(("rId1", "hyperlink", f"https://example.org/{k}"), ("rId2", "comments", "../comments1.xml"), ("rId3", "drawing", "../drawings/drawing1.xml")),
        "xl/comments1.xml": comments, "xl/drawings/drawing1.xml": drawing, "xl/drawings/_rels/drawing1.xml.rels": _rels(("rId1", "image", "../media/p.jpg"), ("rId2", "chart", "../charts/chart1.xml")),
        "xl/media/p.jpg": f"image of {k}", "xl/charts/chart1.xml": chart,
    }
    return _zipped(files)


def _zipped(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def ods(k: int, name: str) -> bytes:
    names = 'xmlns:office="urn:o" xmlns:table="urn:t" xmlns:text="urn:x" xmlns:style="urn:s" xmlns:fo="urn:f" xmlns:number="urn:n" xmlns:xlink="urn:l" xmlns:dc="urn:d" xmlns:calcext="urn:c"'
    content = f"""<?xml version="1.0"?><office:document-content {names}><office:automatic-styles>
<style:style style:name="co1" style:family="table-column"><style:table-column-properties style:column-width="{k + 1}cm"/></style:style><style:style style:name="ta1" style:family="table"><style:table-properties table:display="false"/></style:style>
<number:number-style style:name="N1"><number:number number:decimal-places="3"/></number:number-style><number:percentage-style style:name="N2"><number:number number:decimal-places="1"/></number:percentage-style><number:currency-style style:name="N3"><number:currency-symbol>€</number:currency-symbol><number:number number:decimal-places="2"/></number:currency-style>
<style:style style:name="ce1" style:family="table-cell" style:data-style-name="N1"><style:text-properties fo:font-weight="bold" fo:color="#{k:02x}0000" fo:font-size="{k + 8}pt"/><style:table-cell-properties fo:background-color="#ffff00" fo:border="thin solid #000000"/><style:paragraph-properties fo:text-align="end"/></style:style>
<style:style style:name="ce2" style:family="table-cell" style:data-style-name="N3"><style:table-cell-properties fo:border-left="none" fo:border-top="medium dashed #00ff00"/></style:style></office:automatic-styles>
<office:body><office:spreadsheet><table:table table:name="First"><table:table-column table:style-name="co1" table:number-columns-repeated="2"/><table:table-column/>
<table:table-row><table:table-cell table:style-name="ce1" office:value-type="float" calcext:value-type="float" office:value="{k}.25"><text:p>v</text:p></table:table-cell><table:table-cell table:style-name="ce1" office:value-type="string" table:number-columns-spanned="2"><text:p><text:a xlink:href="https://example.org/{k}">{name}</text:a></text:p><text:p>ratio x:y=3 &lt;use xmlns="q"&gt;</text:p></table:table-cell></table:table-row>
<table:table-row table:number-rows-repeated="2"><table:table-cell table:style-name="ce2" office:value-type="currency" office:value="2" table:number-columns-repeated="3"><office:annotation><dc:creator>me</dc:creator><text:p>note {k}</text:p></office:annotation><text:p>2</text:p></table:table-cell></table:table-row>
<table:table-row><table:table-cell office:value-type="boolean" office:boolean-value="true"><text:p>TRUE</text:p></table:table-cell><table:table-cell office:value-type="date" office:date-value="2020-01-0{k % 9 + 1}"><text:p>d</text:p></table:table-cell></table:table-row></table:table>
<table:table table:name="Second" table:style-name="ta1"><table:table-row><table:table-cell/></table:table-row></table:table>
<table:named-expressions><table:named-range table:name="area" table:cell-range-address="First.A1"/></table:named-expressions></office:spreadsheet></office:body></office:document-content>"""
    styles = f"""<office:document-styles {names}><office:styles><style:style style:name="Default" style:family="table-cell"><style:text-properties fo:font-style="italic"/></style:style><style:style style:name="ce2" style:family="table-cell"><style:text-properties fo:font-style="oblique"/></style:style></office:styles></office:document-styles>"""
    item = '<config:config-item config:name="{0}">{1}</config:config-item>'
    settings = f"""<office:document-settings {names} xmlns:config="urn:g"><office:settings><config:config-item-set config:name="view"><config:config-item-map-indexed config:name="Views"><config:config-item-map-entry><config:config-item-map-named config:name="Tables">
<config:config-item-map-entry config:name="First">{item.format("PositionRight", 1)}{item.format("PositionBottom", k + 1)}</config:config-item-map-entry><config:config-item-map-entry config:name="Second">{item.format("PositionRight", 0)}{item.format("PositionBottom", 0)}</config:config-item-map-entry></config:config-item-map-named></config:config-item-map-entry></config:config-item-map-indexed></config:config-item-set></office:settings></office:document-settings>"""
    return _zipped({"content.xml": content, "styles.xml": styles, "settings.xml": settings})


def xls(k: int, name: str) -> bytes:
    def record(t: int, data: bytes) -> bytes:
        return struct.pack("<HH", t, len(data)) + data

    def font(size: int, flags: int, color: int, line: int, title: str, wide: bool = False) -> bytes:
        body = title.encode("utf-16-le" if wide else "latin-1")
        return record(0x31, struct.pack("<HHHHHBBBBBB", size * 20, flags, color, 400, 0, line, 0, 0, 0, len(title), int(wide)) + body)

    def xf(font: int, fmt: int, align: int, lines: int, pattern: int, fore: int, back: int) -> bytes:
        return record(0xE0, struct.pack("<HHHBBBBIIH", font, fmt, 0, align, 0, 0, 0, lines, pattern << 26, back << 7 | fore))

    looks = font(10, 0, 0x7FFF, 0, "Arial") + font(k + 8, 2, 10, 1, "Courier") + font(9, 8, 12, 0, "Grüße", True) + font(9, 0, 8, 0, "Arial") + font(12, 0, 17, 0, "Fifth")
    looks += record(0x41E, struct.pack("<HHB", 164, 5, 0) + b"0.0\"k") + record(0x41E, struct.pack("<HHB", 165, 2, 1) + "€0".encode("utf-16-le"))
    looks += xf(0, 0, 0x20, 0, 0, 64, 65) + xf(1, 164, 0x1A, 0x1111, 1, 13, 65) + xf(2, 165, 0x03, 0x0010, 2, 64, 11) + xf(5, 0, 0x20, 0, 1, 64, 65)
    title = b"Looks"
    text = name.encode("utf-16-le")
    sst = record(0xFC, struct.pack("<IIHB", 1, 1, len(name), 1) + text)
    tail = looks + sst + record(0x0A, b"")
    at = len(record(0x809, bytes(16))) + 4 + 8 + len(title) + len(tail)
    out = record(0x809, struct.pack("<HH12x", 0x600, 5)) + record(0x85, struct.pack("<IBBBB", at, 0, 0, len(title), 0) + title) + tail + record(0x809, struct.pack("<HH12x", 0x600, 0x10))
    out += record(0x7D, struct.pack("<HHHHH", 1, 2, 256 * (k + 1), 0, 1)) + record(0x208, struct.pack("<HHHHHHHH", 0, 0, 5, 20 * (k + 15), 0, 0, 0x20, 0))
    out += record(0xFD, struct.pack("<HHHI", 0, 0, 1, 0)) + record(0xBD, struct.pack("<HHHIHIH", 0, 1, 1, k << 2 | 2, 2, (100 * k + 25) << 2 | 3, 2)) + record(0x205, struct.pack("<HHHBB", 0, 3, 0, 7, 1)) + record(0x205, struct.pack("<HHHBB", 0, 4, 3, 1, 0))
    out += record(0xBE, struct.pack("<HHHHH", 1, 0, 1, 2, 1)) + record(0x203, struct.pack("<HHHd", 1, 2, 0, k / 4))
    # a formula whose text value follows, and a shared formula over two rows: A + 1 of the row above
    out += record(0x06, struct.pack("<HHHBB3xBHHIH", 2, 0, 0, 0, 0, 0, 0xFFFF, 0, 0, 3 + len(name[:1])) + struct.pack("<BBB", 0x17, 1, 0) + name[:1].encode()) + record(0x207, struct.pack("<HB", len(name), 1) + text)
    for r in (3, 4):
        out += record(0x06, struct.pack("<HHHdHIH", r, 1, 0, 1.5, 8, 0, 5) + struct.pack("<BHH", 0x01, 3, 1))
        if r == 3:
            tokens = struct.pack("<BHH", 0x2C, 0xFFFF, 0xC0FF) + struct.pack("<BHB", 0x1E, 1, 0x03)
            out += record(0x4BC, struct.pack("<HHBBBBH", 3, 4, 1, 1, 0, 2, len(tokens)) + tokens)
    out += record(0xE5, struct.pack("<HHHHHHHHH", 2, 0, 1, 0, 1, 2, k + 3, 2, 2))
    return compound("Workbook", out + record(0x0A, b""))


def dbf(k: int, name: str) -> bytes:
    """All field types; the second record is deleted."""
    fields = [("C", "C", 20, 0), ("N", "N", 10, 2), ("F", "F", 8, 0), ("L", "L", 1, 0), ("D", "D", 8, 0), ("I", "I", 4, 0), ("Y", "Y", 8, 0), ("T", "T", 8, 0), ("B", "B", 8, 0), ("G", "G", 10, 0), ("E", "C", 3, 0)]
    size = 1 + sum(f[2] for f in fields)
    head = struct.pack("<B3BIHH", 0x30, 124, 3, 9, 2, 33 + 32 * len(fields), size) + bytes([0, 0, 0, 1]) + bytes(12) + bytes([1, 3, 0, 0])
    head += b"".join(struct.pack("<11sc4xBB14x", n.encode(), t.encode(), w, d) for n, t, w, d in fields) + b"\r"
    body = name[:20].ljust(20).encode() + f"{k}.25".rjust(10).encode() + str(-k).rjust(8).encode() + b"TF"[k % 2 : k % 2 + 1] + f"202001{k + 1:02d}".encode() + struct.pack("<i", -k) + struct.pack("<q", 10000 * k + 2500) + struct.pack("<II", 2440588 + k, 3_600_000) + struct.pack("<d", k / 4) + bytes(10) + b"   "
    return head + b" " + body + b"*" + body + b"\x1a"


def lotus(k: int, name: str) -> bytes:
    def record(t: int, data: bytes) -> bytes:
        return struct.pack("<HH", t, len(data)) + data

    out = record(0, b"\x04\x04") + record(8, bytes([1, k])) + record(141, struct.pack("<HB", 0, 0) + name.encode() + b"\0")
    out += record(13, struct.pack("<BHHh", 0x80, 0, 0, -k)) + record(15, struct.pack("<BHH", 0, 1, 0) + b"^" + name.encode() + b"\0") + record(12, struct.pack("<BHH", 0, 2, 0))
    out += record(16, struct.pack("<BHHdH", 0, 0, 1, k / 4, 0)) + record(16, struct.pack("<BHHdH", 0, 1, 1, 0, 0)) + record(51, struct.pack("<BHH", 0, 1, 1) + b"calc\0")
    out += record(141, struct.pack("<HB", 1, 0) + b"Two\0") + record(14, struct.pack("<BHHd", 0, 0, 0, k / 2))
    return out + record(1, b"")


def xml2003(k: int, name: str) -> str:
    return f"""<?xml version="1.0"?><ss:Workbook xmlns:ss="urn:x" xmlns:x="urn:y"><ss:Styles><ss:Style ss:ID="s1"><ss:Alignment ss:Horizontal="Right" ss:Vertical="Center" ss:WrapText="1"/><ss:Borders><ss:Border ss:Position="Left" ss:LineStyle="Dash" ss:Weight="0" ss:Color="#FF0000"/><ss:Border ss:Position="Bottom" ss:LineStyle="Double" ss:Weight="3"/><ss:Border ss:Position="Top" ss:LineStyle="None"/></ss:Borders>
<ss:Font ss:FontName="Arial" ss:Size="{k + 8}" ss:Bold="1" ss:Color="#00FF00"/><ss:Interior ss:Color="#112233" ss:Pattern="Solid"/><ss:NumberFormat ss:Format="[$€-407]#,##0.0{'0' * (k % 3)}"/></ss:Style><ss:Style ss:ID="s2"><ss:NumberFormat ss:Format="0.00e+00"/></ss:Style><ss:Style ss:ID="s3"><ss:NumberFormat ss:Format="dd-mmm-yy"/></ss:Style></ss:Styles>
<ss:Names><ss:NamedRange ss:Name="_xlnm.Area" ss:RefersTo="=Main!R1C1"/></ss:Names>
<ss:Worksheet ss:Name="Main"><ss:Table ss:DefaultColumnWidth="60"><ss:Column ss:Width="{k + 10}"/><ss:Column ss:Index="3" ss:Width="20.5" ss:Span="1" ss:Hidden="1"/>
<ss:Row ss:Height="{k + 20}"><ss:Cell ss:StyleID="s1"><ss:Data ss:Type="String">{name} see a:b=1 &lt;x:y&gt; xmlns="q"</ss:Data><ss:Comment ss:Author="me"><ss:Data>c:d=2</ss:Data></ss:Comment></ss:Cell><ss:Cell ss:Index="3" ss:StyleID="s2" ss:MergeAcross="1" ss:MergeDown="{k}"><ss:Data ss:Type="Number">{k}</ss:Data></ss:Cell><ss:Cell><ss:Data ss:Type="Boolean">1</ss:Data></ss:Cell></ss:Row>
<ss:Row ss:Index="4" ss:Hidden="1"><ss:Cell ss:Formula="=RC[1]+R1C1&amp;&quot;a:b=&quot;"><ss:Data ss:Type="Error">#N/A</ss:Data></ss:Cell></ss:Row></ss:Table>
<x:WorksheetOptions><x:ProtectObjects>True</x:ProtectObjects><x:ProtectScenarios>False</x:ProtectScenarios><x:EnableSelection>NoSelection</x:EnableSelection><x:FreezePanes/><x:SplitHorizontal>{k + 1}</x:SplitHorizontal><x:SplitVertical>2</x:SplitVertical><x:DoNotDisplayGridlines/></x:WorksheetOptions></ss:Worksheet>
<ss:Worksheet ss:Name="None"><x:WorksheetOptions><x:Visible>SheetHidden</x:Visible></x:WorksheetOptions></ss:Worksheet></ss:Workbook>"""


def sylk(k: int, name: str) -> str:
    """A registered format, an own one over it, borders that meet, escapes, both kinds of widths and bounds."""
    rows = ["ID;P", "B;Y9;X" + str(k + 5), "F;P1;SB;C3", "F;W2 3 " + str(k + 1), "W;X5;W7", "C;Y1;X1;P1;K5", f'C;P1;SI;H{k + 8};K"{name};;\x1bN0C"', "F;SLRM1;Y2;X1;G1;C5", 'C;Y2;X1;K"a"', "F;SLM1;Y2;X2", "C;Y2;X2;M0.00;K1", "C;Y3;X1;ER[-1]C+1;K2;AC", "E", "C;Y9;X9;K1"]
    return "\n".join(rows) + "\n"


def dif(k: int, name: str) -> str:
    rows = ["TABLE", "0,1", f'"{name}"', "VECTORS", "0,3", '""', "TUPLES", "0,1", '""', "LABEL", "1,0", '"one"', "LABEL", "2,0", '"two"', "COMMENT", "0,0", f'"note {k}"', "DATA", "0,0", '""']
    rows += ["-1,0", "BOT", f"0,{k}.5", "V", "1,0", f'"{name}"', "2,1", "TRUE", "2,-2", "NA", "-1,0", "EOD"]
    return "\n".join(rows) + "\n"


def html(k: int, name: str) -> str:
    """A foot before the body, a second body, spans, and text that is no table's."""
    return f"""<script>var t = "<td>";</script><table><tfoot><tr><td>foot</td></tr></tfoot><tr><td rowspan="2" title="note {k}" style="color: red">{name}</td><td colspan="2">b&amp;c</td></tr><tr><th>h</th><td data-formula="A1+{k}">9</td></tr>
<thead><tr><td>head</td></tr></thead></table><table><tr><td>second</td></tr></table>"""


BINARY: dict[str, Callable[[int, str], bytes]] = {"xlsx": xlsx, "ods": ods, "xls": xls, "dbf": dbf, "lotus": lotus}
TEXT: dict[str, Callable[[int, str], str]] = {"xml": xml2003, "sylk": sylk, "dif": dif, "html": html}


def showcase(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """(doc_id, content) of a binary form or (doc_id, text) of a text form, one for each nation."""
    make = BINARY.get(form) or TEXT[form]

    @F.pandas_udf("binary" if form in BINARY else "string")
    def made(key: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([make(int(k), n) for k, n in zip(key, name, strict=True)], dtype=object)

    key = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(key.alias("doc_id"), made("n_nationkey", "n_name").alias("content" if form in BINARY else "text"))
