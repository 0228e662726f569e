"""Sinks: chapter texts, merged books, summaries, EPUB."""

from __future__ import annotations

import html
import os
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.textclean import safe_filename


def body(status: Column, content: Column, source_pages: Column) -> Column:
    """A chapter's text; a note after a partial one; three lines in place of none."""
    note = F.concat(F.lit("【本章状态："), status, F.lit("，未完整收录】"))
    none = F.concat(F.lit("【本章未能正常提取】状态："), status, F.lit("\n源页面："), F.array_join(source_pages, " , "), F.lit("\n（受限或异常页不会被当作正文静默保存）"))
    c = F.coalesce(content, F.lit(""))
    return F.when(status == "CONTENT_OK", c).when(F.trim(c) != "", F.concat(c, F.lit("\n\n"), note)).otherwise(none)


def file_name(index: Column, title: Column) -> Column:
    return F.concat(F.rtrim(F.concat(F.format_string("%04d ", index), safe_filename(F.coalesce(title, F.lit(""))))), F.lit(".txt"))


def merged(chapters: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, text): chapters in order with their titles; a book has at most as many chapters as are read of one."""
    part = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.col("body"), F.lit("\n"))
    g = chapters.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))).alias("s"))
    return g.select(book, F.concat(F.trim(F.array_join(F.transform("s", lambda x: x["t"]), "\n")), F.lit("\n")).alias("text"))


def summary(chapters: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, status, n): the distribution of statuses."""
    return chapters.groupBy(book, "status").agg(F.count("*").alias("n"))


def write_books(books: DataFrame, path: str, book: str = "book_id") -> None:
    """One text file per book, written by the tasks."""
    books.select(F.col(book).cast("string").alias("book"), "text").write.mode("overwrite").partitionBy("book").text(path)


def write_chapters(chapters: DataFrame, folder: str) -> list[str]:
    """Files of one book's chapters (pos, title, body), read row by row; returns their names in order."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for r in chapters.select("pos", file_name(F.col("pos"), F.col("title")).alias("name"), "body").orderBy("pos").toLocalIterator():
        with open(os.path.join(folder, r["name"]), "w", encoding="utf-8", newline="\n") as f:
            f.write(r["body"])
        names.append(r["name"])
    return names


def chapter_html(title: str, text: str) -> str:
    """XHTML of a chapter: paragraphs parted by blank lines."""
    paras = [p.strip() for p in text.split("\n\n") if p.strip()] or ["（空）"]
    inner = "".join(f"<p>{html.escape(p, quote=False)}</p>" for p in paras)
    return f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{html.escape(title)}</title></head><body><h2>{html.escape(title)}</h2>{inner}</body></html>'


def write_epub(chapters: DataFrame, path: str, title: str, author: str | None = None) -> int:
    """An EPUB of one book's chapters (pos, title, body) in order; returns their number."""
    items, nav = [], []
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        for r in chapters.select("pos", "title", "body").orderBy("pos").toLocalIterator():
            name = f"c{r['pos']:05d}.xhtml"
            z.writestr(name, chapter_html(r["title"] or "", r["body"] or ""), zipfile.ZIP_DEFLATED)
            items.append(name)
            nav.append(f'<li><a href="{name}">{html.escape(r["title"] or "")}</a></li>')
        z.writestr("nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{"".join(nav)}</ol></nav></body></html>')
        manifest = "".join(f'<item id="i{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(items))
        spine = "".join(f'<itemref idref="i{i}"/>' for i in range(len(items)))
        creator = f"<dc:creator>{html.escape(author)}</dc:creator>" if author else ""
        z.writestr("book.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{html.escape(title)}</dc:identifier><dc:title>{html.escape(title)}</dc:title>{creator}<dc:language>zh</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>{manifest}</manifest><spine>{spine}</spine></package>')
    return len(items)
