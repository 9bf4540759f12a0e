"""The same answers as ``plans.queries`` in DuckDB SQL, over the whole tables."""

from __future__ import annotations

from citeloom.plans.driver_view import BASE, BIB, MIXED

NESTED = """
    string_split(label_csv, ',') AS labelsNamed,
    list_transform(string_split(label_csv, ','), lambda x: concat('L-', x)) AS labels,
    string_split(folder_csv, ',') AS foldersNamed,
    list_transform(string_split(folder_csv, ','), lambda x: concat('F-', x)) AS folders,
    struct_pack("year" := pub_year_src) AS published,
    list_transform(range(0, ord % 4), lambda i: struct_pack(
        formatted := concat('Name', (ord * 7 + i) % 97, ' A'),
        "last" := concat('Name', (ord * 7 + i) % 97))) AS author,
    CASE WHEN ord % 3 = 0 THEN [struct_pack(
        source_filename := CASE WHEN ord % 6 = 0 THEN '[article_pdf].pdf' ELSE 'x.pdf' END,
        filename := concat(_id, '.pdf'),
        gdrive_id := CASE WHEN ord % 12 = 3 THEN concat('a', ord) END)] ELSE [] END AS attachments
"""

_BASE_SQL = ", ".join(f"{sql} AS {name}" for name, sql in BASE.items())
LIB = (
    f"base AS (SELECT {_BASE_SQL} FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), "
    f"lib AS (SELECT *, {NESTED} FROM base)"
)

REC = (
    LIB
    + """, r1 AS (
  SELECT ord, _id, coalesce(abstract, '') AS abstract, coalesce(citekey, '-') AS citekey, title,
    coalesce(issue, '') AS issue, coalesce(pages, '') AS pages,
    coalesce(replace(journal, '.', ''), '-') AS journal, coalesce(pmid, '-') AS pmid,
    coalesce(author[1]."last", '') AS first, coalesce(author[-1]."last", '') AS last,
    coalesce(array_to_string([a.formatted FOR a IN author], ', '), '') AS authors,
    coalesce(published."year", '-') AS year,
    CASE WHEN kind IN ('Commentary', 'Review', 'News') THEN kind ELSE pubtype END AS type,
    coalesce(label_csv, '') AS label, coalesce(array_to_string(labels, ','), '') AS labelID,
    coalesce(folder_csv, '') AS folder, coalesce(array_to_string(folders, ','), '') AS folderID,
    CASE WHEN len(attachments) > 0 THEN '📜' ELSE ' ' END AS pdfFlag,
    coalesce(attachments[1].gdrive_id, gdrive_id, '') AS gdrive_id,
    attachments, labelsNamed, labels, foldersNamed, folders
  FROM lib WHERE incomplete <> 1
), rec AS (
  SELECT *,
    CASE WHEN len(attachments) = 0 THEN ''
      WHEN attachments[1].source_filename = '[article_pdf].pdf'
        THEN replace(attachments[1].filename, '...  ', '... ')
      ELSE replace(concat(first, '*', substr(title, 1, 30), '*'), '...  ', '... ')
    END AS fileName,
    concat(first, '-', last, ', ', journal, ' ', year) AS subtitle,
    concat(authors, '. ', title, '. ', journal, ' ', year, ';', issue, ':', pages,
      '. PMID: ', pmid)
      AS fullReference
  FROM r1
)"""
)

COLUMNS = [
    "_id", "abstract", "citekey", "fileName", "first", "folder", "folderID", "fullReference",
    "journal", "label", "labelID", "last", "pdfFlag", "pmid", "subtitle", "title", "gdrive_id",
    "type", "year",
]

SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _tokens(text: str) -> str:
    folded = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(string_split_regex({folded}, '{SEP}'), lambda t: t <> '')"


_UNPIVOT = " UNION ALL ".join(f"SELECT _id, year, '{c}' AS col, {c} AS txt FROM rec" for c in COLUMNS)
POST = (
    REC
    + f""", cells AS ({_UNPIVOT}),
toks AS (SELECT _id, year, col, {_tokens('txt')} AS tok FROM cells),
post AS (SELECT _id, year, col, unnest(tok) AS term, generate_subscripts(tok, 1) - 1 AS pos
  FROM toks)"""
)
_ALL_TEXT = "concat_ws(' ', " + ", ".join(COLUMNS) + ")"
WORDS = REC + f", w AS (SELECT *, {_tokens(_ALL_TEXT)} AS tok FROM rec)"


def _has(word: str) -> str:
    return f"list_contains(tok, '{word}')"


def _has_prefix(prefix: str) -> str:
    return f"len(list_filter(tok, lambda t: starts_with(t, '{prefix}'))) > 0"


def _ids_with(condition: str) -> str:
    return f"SELECT _id FROM post WHERE {condition}"


def _near(a: str, b: str, distance: int) -> str:
    return (
        "SELECT p._id FROM post p JOIN post q ON p._id = q._id AND p.col = q.col"
        f" WHERE p.term = '{a}' AND q.term = '{b}' AND p.pos <> q.pos"
        f" AND abs(p.pos - q.pos) <= {distance + 1}"
    )


_PHRASE = (
    "SELECT p._id FROM post p JOIN post q ON p._id = q._id AND p.col = q.col AND q.pos = p.pos + 1"
    " WHERE p.term = '{0}' AND {1}"
)

# (WITH prefix, source, condition) of each match query.
MATCHES = {
    "search_term": (WORDS, "w", _has("thanedble")),
    "search_and": (WORDS, "w", f"{_has('thanedble')} AND {_has('and')} AND {_has('src1')}"),
    "search_prefix": (WORDS, "w", f"{_has_prefix('thaned')} AND {_has('onor')}"),
    "search_field": (
        POST, "rec",
        "_id IN (" + _ids_with("term = 'the' AND col = 'title'") + ") AND _id IN ("
        + _ids_with("term = 'src1' AND col = 'label'") + ")",
    ),
    "search_phrase": (
        POST, "rec",
        "_id IN (" + _PHRASE.format("of", "q.term = 'the'") + ") AND _id IN ("
        + _PHRASE.format("and", "starts_with(q.term, 'th')") + ")",
    ),
    "search_or": (
        POST, "rec",
        "_id IN (" + _ids_with("term IN ('thanedble', 'onwh')") + ") AND _id IN ("
        + _ids_with("term = 'review' AND col = 'type'") + ")",
    ),
    "search_not": (
        WORDS, "w",
        f"({_has('that')} OR {_has('der')}) AND NOT ({_has('the')} AND {_has('of')})",
    ),
    "search_near": (
        POST, "rec",
        f"(_id IN ({_near('thanedble', 'the', 3)}) OR _id IN ({_near('der', 'die', 10)}))",
    ),
}


def _facet(names: str, ids: str, name: str, key: str) -> str:
    return (
        REC
        + f""", pairs AS (
  SELECT ord, generate_subscripts({names}, 1) AS pos, unnest({names}) AS {name},
    unnest({ids}) AS id, replace(lower(type), 'pp_', '') AS kind
  FROM rec WHERE {names} IS NOT NULL
), kinds AS (
  SELECT {name}, kind, count(*) AS n FROM pairs WHERE {name} <> '' GROUP BY ALL
), firsts AS (
  SELECT {name}, count(*) AS total, arg_min(id, ord * 1000 + pos) AS {key}, min(ord) AS first_ord
  FROM pairs WHERE {name} <> '' GROUP BY ALL
), facet AS (
  SELECT f.{name}, f.total, f.{key},
    (SELECT string_agg(concat(k.kind, ' (', k.n, ') '), '' ORDER BY k.n DESC, k.kind)
     FROM kinds k WHERE k.{name} = f.{name}) AS summary, f.first_ord
  FROM firsts f
)"""
    )


LABEL_FACET = _facet("labelsNamed", "labels", "label", "label_id")


def _refreshed(ctes: str) -> str:
    """Without the records of the folder that the refresh finds empty."""
    return ctes.replace("WHERE incomplete <> 1", "WHERE incomplete <> 1 AND ord % 8 <> 5")


FOLDER_FACET = _facet("foldersNamed", "folders", "folder", "folder_id")

BIB_SQL = (
    "b AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in BIB.items())
    + " FROM documents d)"
)
BIB_NAMES = (
    BIB_SQL
    + r""", n1 AS (
  SELECT *, list_filter(string_split_regex(author, '\s+and\s+'), lambda n: trim(n) <> '') AS raw
  FROM b
), n AS (
  SELECT *, list_transform(raw, lambda x: CASE WHEN contains(x, ',')
    THEN concat(trim(string_split(x, ',')[1]), ' ',
      array_to_string(list_transform(list_filter(
        string_split_regex(substr(x, strpos(x, ',') + 1), '\s+'), lambda p: p <> ''),
        lambda p: upper(substr(p, 1, 1))), ''))
    ELSE trim(x) END) AS names FROM n1
), bib AS (
  SELECT ID AS myID, file AS myFile, len(raw) AS n_authors,
    coalesce(array_to_string(names, ', '), '') AS authorBlock,
    coalesce(string_split_regex(names[1], '\s+')[1], '') AS firstAuthor,
    coalesce(string_split_regex(names[-1], '\s+')[1], '') AS lastAuthor,
    coalesce(replace(journal, '.', ''), '') AS journal,
    regexp_replace(regexp_replace(title, '^\{', ''), '\}\z', '') AS title, year,
    coalesce(volume, '-') AS volume, pages, pmid AS source_pmid, coalesce(pmid, '') AS pmid,
    coalesce(annot, '') AS annot
  FROM n
)"""
)

BATCH = (
    POST
    + f""", sentences AS (
  SELECT item_id, string_split(text, '.') AS parts FROM benchmark
), numbered AS (
  SELECT item_id * 1000 + generate_subscripts(parts, 1) - 1 AS query_id, unnest(parts) AS sentence
  FROM sentences
), asked AS (
  SELECT query_id, {_tokens('sentence')} AS tok, regexp_matches(sentence,
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]\\z') AS open_end
  FROM numbered
), clause AS (
  SELECT DISTINCT query_id, term, open_end AND pos = n AS is_prefix FROM (
    SELECT query_id, open_end, len(tok) AS n, unnest(tok) AS term,
      generate_subscripts(tok, 1) AS pos FROM asked)
), wanted AS (
  SELECT query_id, count(*) AS n_clauses FROM clause GROUP BY ALL
), doc_terms AS (
  SELECT DISTINCT _id, term FROM post
), hits AS (
  SELECT c.query_id, c.term, c.is_prefix, t._id FROM clause c JOIN doc_terms t ON c.term = t.term
  WHERE NOT c.is_prefix
  UNION
  SELECT c.query_id, c.term, c.is_prefix, t._id
  FROM clause c JOIN doc_terms t ON starts_with(t.term, c.term) WHERE c.is_prefix
), full_hits AS (
  SELECT h.query_id, h._id, count(*) AS n FROM hits h GROUP BY ALL
), ranked AS (
  SELECT f.query_id, f._id, r.year,
    row_number() OVER (PARTITION BY f.query_id ORDER BY r.year DESC, r.ord) AS rank
  FROM full_hits f JOIN wanted w ON f.query_id = w.query_id AND f.n = w.n_clauses
  JOIN rec r ON r._id = f._id
)
SELECT query_id, rank, _id, year FROM ranked WHERE rank <= 99"""
)

TREES = (
    POST
    + f""", sentences AS (
  SELECT item_id, string_split(text, '.') AS parts FROM benchmark
), numbered AS (
  SELECT item_id * 1000 + generate_subscripts(parts, 1) - 1 AS query_id, unnest(parts) AS sentence
  FROM sentences
), q AS (
  SELECT query_id, len(tok) AS n, tok[1] AS a, tok[2] AS b, tok[3] AS c, tok[4] AS d,
    CASE WHEN len(tok) < 4 THEN 9 ELSE query_id % 4 END AS form
  FROM (SELECT query_id, {_tokens('sentence')} AS tok FROM numbered) WHERE len(tok) > 0
), holds AS (SELECT DISTINCT _id, term FROM post
), phrase0 AS (
  SELECT query_id, p._id FROM q JOIN post p ON p.term = q.a
    JOIN post r ON r._id = p._id AND r.col = p.col AND r.pos = p.pos + 1 AND r.term = q.b WHERE form = 0
  UNION SELECT query_id, p._id FROM q JOIN post p ON p.term = q.c
    JOIN post r ON r._id = p._id AND r.col = p.col AND r.pos = p.pos + 1 AND starts_with(r.term, q.d)
    WHERE form = 0
), both1 AS (
  SELECT query_id, x._id FROM q JOIN holds x ON x.term = q.a JOIN holds y ON y._id = x._id AND y.term = q.b
  WHERE form = 1
  EXCEPT SELECT query_id, x._id FROM q JOIN holds x ON x.term = q.c WHERE form = 1
), near2 AS (
  SELECT DISTINCT query_id, p._id FROM q JOIN post p ON p.term = q.a
    JOIN post r ON r._id = p._id AND r.col = p.col AND r.term = q.c AND r.pos <> p.pos
      AND abs(r.pos - p.pos) <= 4
    JOIN rec ON rec._id = p._id AND list_contains(rec.labels, 'L-src1') WHERE form = 2
), field3 AS (
  SELECT query_id, p._id FROM q JOIN post p ON p.term IN (q.a, q.b) AND p.col = 'title' WHERE form = 3
  INTERSECT SELECT query_id, x._id FROM q JOIN holds x ON starts_with(x.term, left(q.c, 3)) WHERE form = 3
), found AS (
  FROM phrase0 UNION ALL FROM both1 UNION ALL FROM near2 UNION ALL FROM field3
  UNION ALL SELECT query_id, x._id FROM q JOIN holds x ON x.term = q.a WHERE form = 9
), ranked AS (
  SELECT f.query_id, f._id, r.year,
    row_number() OVER (PARTITION BY f.query_id ORDER BY r.year DESC, r.ord) AS rank
  FROM found f JOIN rec r ON r._id = f._id
)
SELECT query_id, rank, _id, year FROM ranked WHERE rank <= 99"""
)

RESOLVE = (
    REC
    + """, listing AS (
  SELECT unnest([concat('/lib/b/', _id, '.pdf'), concat('/lib/a', ord % 5, '/', _id, '.pdf'),
    concat('/lib/', ord % 10, '/', coalesce(author[1]."last", ''), ' - ',
      replace(title, '/', '_'), '.pdf')]) AS path
  FROM lib WHERE ord % 4 <> 2
  UNION ALL SELECT url FROM pages
), files AS (
  SELECT path, string_split(path, '/')[-1] AS basename FROM listing
), wanted AS (
  SELECT *, attachments[1].source_filename = '[article_pdf].pdf' AS is_exact,
    replace(substr(title, 1, 30), '...  ', '... ') AS lit
  FROM rec
), hit AS (
  SELECT w._id, min(f.path) AS path FROM wanted w JOIN files f ON f.basename = w.fileName
  WHERE w.is_exact GROUP BY ALL
  UNION ALL
  SELECT w._id, min(f.path) AS path FROM wanted w JOIN files f
    ON starts_with(f.basename, w.first) AND contains(substr(f.basename, length(w.first) + 1), w.lit)
  WHERE len(w.attachments) > 0 AND NOT w.is_exact GROUP BY ALL
)
SELECT w._id, w.fileName, h.path FROM wanted w LEFT JOIN hit h ON w._id = h._id"""
)

REFRESH = """WITH now AS (
  SELECT concat('/in/', page_id, '/', url) AS path, page_id * 60 AS t FROM pages
  WHERE page_id % 7 <> 3
), seen AS (
  SELECT concat('/in/', page_id, '/', url) AS path,
    page_id * 60 + CASE page_id % 5 WHEN 1 THEN 60 WHEN 2 THEN -60 ELSE 0 END AS t
  FROM pages WHERE page_id % 5 <> 0
)
SELECT path, 'new' AS status FROM now WHERE path NOT IN (SELECT path FROM seen)
UNION ALL SELECT path, 'removed' FROM seen WHERE path NOT IN (SELECT path FROM now)
UNION ALL SELECT n.path, 'changed' FROM now n JOIN seen s ON n.path = s.path WHERE n.t <> s.t"""

# Keys of a JSON line: absent values are not written, nested objects always are.
LINE_KEYS = {
    "ord": "ord", "_id": "_id", "incomplete": "incomplete", "title": "title",
    "abstract": "abstract", "pubtype": "pubtype", "kind": "kind", "journal": "journal",
    "pmid": "pmid", "citekey": "citekey", "issue": "issue", "pages": "pages",
    "gdrive_id": "gdrive_id", "labelsNamed": "label_csv", "labels": "label_csv",
    "foldersNamed": "folder_csv", "folders": "folder_csv", "published": "ord", "author": "ord",
    "attachments": "ord",
}

RAW_COLUMNS = """cast(ord AS varchar) AS ord, _id, cast(incomplete AS varchar) AS incomplete, title,
  abstract, pubtype, kind, journal, pmid, citekey, issue, pages, gdrive_id,
  cast(to_json(labelsNamed) AS varchar) AS labelsNamed, cast(to_json(labels) AS varchar) AS labels,
  cast(to_json(foldersNamed) AS varchar) AS foldersNamed,
  cast(to_json(folders) AS varchar) AS folders,
  CASE WHEN published."year" IS NULL THEN '{}' ELSE cast(to_json(published) AS varchar) END
    AS published,
  cast(to_json(author) AS varchar) AS author, replace(cast(to_json(attachments) AS varchar), ',"gdrive_id":null', '') AS attachments"""


def _rec(columns: str, where: str = "") -> str:
    return f"WITH {REC} SELECT {columns} FROM rec {where}"


def _links(ids: str, base: str) -> str:
    return (
        f"coalesce(array_to_string(list_transform({ids}, lambda x:"
        f" concat('https://library.example/{base}/', x)), ','), '')"
    )


TOP = f"w.tok IS NOT NULL AND {_has('the')} AND {_has_prefix('an')}"


def _top(direction: str) -> str:
    return (
        f"WITH {WORDS} SELECT ord, _id, year, title FROM w WHERE {TOP}"
        f" ORDER BY year {direction}, ord LIMIT 99"
    )


MIXED_FIELDS = f"""j AS (SELECT CAST({MIXED} AS JSON) AS j, d.doc_id, d.n_chars, d.lang FROM documents d),
f AS (
  SELECT concat('d', doc_id) AS _id, '_id' AS field, 'STRING' AS type, concat('d', doc_id) AS text FROM j
  UNION ALL SELECT concat('d', doc_id), 'rank', CASE json_type(j, '$.rank') WHEN 'UBIGINT' THEN 'BIGINT'
    WHEN 'VARCHAR' THEN 'STRING' WHEN 'ARRAY' THEN 'ARRAY<VARIANT>' ELSE 'VOID' END, json_extract_string(j, '$.rank') FROM j
  UNION ALL SELECT concat('d', doc_id), 'size', concat('OBJECT<chars: BIGINT',
    CASE WHEN json_type(j, '$.size.lang') IS NULL THEN '' ELSE ', lang: STRING' END, '>'),
    json_extract_string(j, '$.size') FROM j
  UNION ALL SELECT concat('d', doc_id), 'size.chars', 'BIGINT', json_extract_string(j, '$.size.chars') FROM j
  UNION ALL SELECT concat('d', doc_id), 'size.lang', 'STRING', json_extract_string(j, '$.size.lang') FROM j
    WHERE json_type(j, '$.size.lang') IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    found = {
        "library_scan": f"""WITH {LIB} SELECT _id, cast(incomplete AS varchar) AS incomplete, title,
            abstract, pub_year_src AS year,
            coalesce(array_to_string([a.formatted FOR a IN author], ', '), '') AS authors,
            journal, pmid, coalesce(label_csv, '') AS label,
            coalesce(array_to_string(folders, ','), '') AS folderID,
            attachments[1].filename AS filename, pubtype, kind FROM lib""",
        "raw_import": f"WITH {LIB} SELECT {RAW_COLUMNS} FROM lib",
        "raw_fields": f"WITH {LIB}, raw AS (SELECT {RAW_COLUMNS} FROM lib) " + " UNION ALL ".join(
            f"SELECT _id, '{key}' AS field, {key} AS text FROM raw WHERE {key} IS NOT NULL"
            for key in LINE_KEYS
        ),
        "schema_keys": f"WITH {LIB} " + " UNION ALL ".join(
            f"SELECT '{key}' AS key, count({source}) AS n_records FROM lib"
            f" HAVING count({source}) > 0"
            for key, source in LINE_KEYS.items()
        ),
        "variant_fields": f"WITH {MIXED_FIELDS} SELECT * FROM f",
        "variant_schema": f"""WITH {MIXED_FIELDS} SELECT field, CASE WHEN count(DISTINCT type) = 1
            THEN min(type) WHEN field = 'size' THEN arg_max(type, length(type)) ELSE 'VARIANT' END AS type,
            count(*) AS n_values FROM f GROUP BY field""",
        "union_schema": """SELECT cast(conv_id AS varchar) AS conv_id, cast(turn AS varchar) AS turn,
            role, text, NULL::varchar AS event_id, NULL::varchar AS user_id,
            NULL::varchar AS event_type, NULL::varchar AS props, NULL::varchar AS ts,
            NULL::varchar AS value, NULL::varchar AS item_id FROM conversations
            UNION ALL SELECT NULL, NULL, NULL, NULL, cast(event_id AS varchar),
            cast(user_id AS varchar), event_type, props, cast(ts AS varchar),
            cast(value AS varchar), NULL FROM events
            UNION ALL SELECT NULL, NULL, NULL, text, NULL, NULL, NULL, NULL, NULL, NULL,
            cast(item_id AS varchar) FROM benchmark""",
        "label_export": f"WITH {LIB} SELECT {RAW_COLUMNS} FROM lib"
        " WHERE list_contains(labelsNamed, 'interesting')",
        "complete_only": f"WITH {LIB} SELECT _id, title FROM lib WHERE incomplete <> 1",
        "defaults": f"""WITH {LIB} SELECT coalesce(pmid, '-') AS pmid,
            coalesce(citekey, '-') AS citekey, coalesce(journal, '-') AS journal,
            coalesce(abstract, '') AS abstract, coalesce(issue, '') AS issue,
            coalesce(pages, '') AS pages, coalesce(gdrive_id, '') AS gdrive_id, _id FROM lib""",
        "journal_clean": _rec("_id, journal"),
        "author_block": _rec("_id, authors"),
        "first_last": _rec("_id, first, last"),
        "pub_year": _rec("_id, year"),
        "pub_type": _rec("_id, type"),
        "label_text": _rec("_id, label, labelID, folder, folderID"),
        "file_pattern": _rec("_id, fileName, gdrive_id"),
        "pdf_flag": _rec("_id, pdfFlag"),
        "short_ref": _rec("_id, subtitle"),
        "full_ref": _rec("_id, fullReference"),
        "display_type": _rec(
            "_id, concat(upper(substr(replace(replace(type, 'PP_', ''), '_', ' '), 1, 1)),"
            " lower(substr(replace(replace(type, 'PP_', ''), '_', ' '), 2))) AS display_type,"
            " replace(lower(type), 'pp_', '') AS summary_type"
        ),
        "links": _rec(
            "_id, concat('https://library.example/p/', _id) AS record_link,"
            " CASE WHEN gdrive_id <> '' THEN"
            " concat('https://drive.example/file/', gdrive_id) END AS drive_link,"
            f" {_links('labels', 'label')} AS label_links,"
            f" {_links('folders', 'folder')} AS folder_links"
        ),
        "library_normalize": _rec("ord, " + ", ".join(COLUMNS)),
        "facet_labels": f"WITH {LABEL_FACET} SELECT * FROM facet ORDER BY total DESC, first_ord",
        "facet_folders": f"WITH {FOLDER_FACET} SELECT * FROM facet ORDER BY total DESC, first_ord",
        "facet_types": f"""WITH {REC}, t AS (SELECT ord, unnest(string_split(type, ',')) AS t
            FROM rec), k AS (SELECT ord, replace(replace(t, 'PP_', ''), '_', ' ') AS t FROM t
            WHERE t <> '')
            SELECT concat(upper(substr(t, 1, 1)), lower(substr(t, 2))) AS type,
            count(*) AS total, min(ord) AS first_ord FROM k GROUP BY 1""",
        "facet_pivot": f"WITH {REC}, p AS (SELECT unnest(labelsNamed) AS name, type FROM rec) "
        "SELECT name, "
        + ", ".join(
            f"""count(*) FILTER (type = '{t}') AS "{t}" """
            for t in ["PP_ARTICLE", "PP_JOURNAL_ARTICLE", "PP_BOOK", "PP_REVIEW", "PP_THESIS",
                      "Review", "News", "Commentary", "PP_BOOK,PP_REVIEW"]
        )
        + " FROM p GROUP BY name",
        "facet_display": f"""WITH {LABEL_FACET} SELECT concat(label, ' (', total, ')') AS display,
            summary AS subtitle, label_id AS scope_id, total, first_ord FROM facet""",
        "facet_search": f"""WITH {LABEL_FACET} SELECT * FROM facet WHERE len(list_filter(
            {_tokens('label')}, lambda t: starts_with(t, 'src1'))) > 0""",
        "postings": f"WITH {POST} SELECT term, col, _id, cast(pos AS integer) AS pos FROM post",
        "term_stats": f"""WITH {POST} SELECT term, count(*) AS n_occurrences,
            count(DISTINCT _id) AS n_records FROM post GROUP BY term""",
        "search_in_label": f"""WITH {WORDS} SELECT _id, label, folder, type FROM w
            WHERE list_contains(labels, 'L-src1') AND {_has_prefix('the')}""",
        "search_in_folder": f"""WITH {WORDS} SELECT _id, label, folder, type FROM w
            WHERE list_contains(folders, 'F-EN_src1') AND {_has_prefix('the')}""",
        "search_in_type": f"""WITH {WORDS} SELECT _id, label, folder, type FROM w
            WHERE type = 'PP_JOURNAL_ARTICLE' AND {_has_prefix('the')}""",
        "search_in_label_postings": f"""WITH {WORDS} SELECT _id, year FROM w
            WHERE list_contains(labels, 'L-src1') AND {_has_prefix('the')}""",
        "search_in_folder_postings": f"""WITH {WORDS} SELECT _id, year FROM w
            WHERE list_contains(folders, 'F-EN_src1') AND {_has_prefix('the')}""",
        "search_in_type_postings": f"""WITH {WORDS} SELECT _id, year FROM w
            WHERE type = 'PP_JOURNAL_ARTICLE' AND {_has_prefix('the')}""",
        "facet_search_folders": f"""WITH {FOLDER_FACET} SELECT * FROM facet WHERE len(list_filter(
            {_tokens('folder')}, lambda t: starts_with(t, 'en'))) > 0""",
        "facet_search_types": f"""WITH {REC}, t AS (SELECT ord, unnest(string_split(type, ',')) AS t
            FROM rec), k AS (SELECT ord, replace(replace(t, 'PP_', ''), '_', ' ') AS t FROM t
            WHERE t <> ''), f AS (
            SELECT concat(upper(substr(t, 1, 1)), lower(substr(t, 2))) AS type,
            count(*) AS total, min(ord) AS first_ord FROM k GROUP BY 1)
            SELECT * FROM f WHERE len(list_filter({_tokens('type')},
              lambda t: starts_with(t, 'art'))) > 0""",
        "search_top_desc": _top("DESC"),
        "search_top_postings": _top("DESC"),
        "search_top_asc": _top("ASC"),
        "search_top_postings_asc": _top("ASC"),
        "search_display": f"""WITH {WORDS}, top AS (SELECT * FROM w WHERE {TOP}
              ORDER BY year DESC, ord LIMIT 99),
            ranked AS (SELECT *, row_number() OVER (ORDER BY year DESC, ord) AS rank,
              count(*) OVER () AS total FROM top)
            SELECT rank, title,
              concat(rank, '/', total, pdfFlag, subtitle, ' 🏷', label) AS display, fileName,
              fullReference, concat(subtitle, ' ', pmid) AS shortPMID, abstract,
              concat('@', citekey) AS citekey, gdrive_id, _id FROM ranked""",
        "search_batch": f"WITH {BATCH}",
        "search_batch_trees": f"WITH {TREES}",
        "bib_scan": f"""WITH {BIB_SQL} SELECT 'article' AS entrytype, ID, author, title, journal,
            year, volume, pages, pmid, annot, file, 'March' AS month FROM b""",
        "bib_authors": f"""WITH {BIB_NAMES} SELECT myID AS ID, coalesce(n_authors, 0) AS n_authors,
            authorBlock FROM bib""",
        "bib_first_last": f"WITH {BIB_NAMES} SELECT myID, firstAuthor, lastAuthor FROM bib",
        "bib_title": f"WITH {BIB_NAMES} SELECT myID, title FROM bib",
        "bib_refs": f"""WITH {BIB_NAMES} SELECT myID, myFile, journal, volume, pmid, annot,
            concat(firstAuthor, '-', lastAuthor, ', ', journal, ' ', year, ' ', pmid) AS shortRef,
            concat(authorBlock, '. ', title, '. ', journal, ' ', year, ';', volume,
              CASE WHEN pages IS NULL THEN '' ELSE concat(':', pages, '.') END,
              CASE WHEN source_pmid IS NULL THEN '' ELSE concat(' PMID: ', source_pmid, '.') END)
              AS fullRef FROM bib""",
        "resolve_files": f"WITH {RESOLVE}",
        "refresh_changed_files": REFRESH,
        "refresh_delta_facet": f"""WITH {_refreshed(LABEL_FACET)}
            SELECT label, total, label_id, summary FROM facet""",
        "refresh_delta_words": f"""WITH {_refreshed(POST)} SELECT term, count(*) AS n_occurrences,
            count(DISTINCT _id) AS n_records FROM post GROUP BY term""",
    }
    for name, (ctes, source, condition) in MATCHES.items():
        found[name] = f"WITH {ctes} SELECT _id, year, title FROM {source} WHERE {condition}"
        found[f"{name}_postings"] = f"WITH {ctes} SELECT _id, year FROM {source} WHERE {condition}"
    return found
