"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quillmark.llm import sharding, warc


def _text(s: str) -> str:
    """A SQL string for ``s``, control characters as chr()."""
    out, plain = [], ""
    for c in s:
        if ord(c) < 32:
            out += [f"'{plain}'"] * bool(plain) + [f"chr({ord(c)})"]
            plain = ""
        else:
            plain += c.replace("'", "''")
    out += [f"'{plain}'"] * bool(plain or not out)
    return "(" + " || ".join(out) + ")"


def _sha1_digest(x: str) -> str:
    groups = " || ".join(f"to_base(('0x' || substr(sha1({x}), {1 + 5 * i}, 5))::bigint, 32, 4)" for i in range(8))
    return f"('sha1:' || translate({groups}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', '{warc.BASE32}'))"


def _urn(x: str) -> str:
    h = f"sha1({x})"
    return f"('<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>')"


def _plain(x: str) -> str:
    x = f"regexp_replace({x}, {_text(warc.HIDDEN)}, ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, {_text(warc.BREAKS)}, chr(10), 'g'), {_text(warc.TAG)}, '', 'g')"
    for name, char in warc.ENTITIES:
        x = f"replace({x}, {_text(name)}, {_text(char)})"
    x = f"regexp_replace(regexp_replace({x}, {_text(warc.BLANKS)}, ' ', 'g'), {_text(warc.EDGES)}, chr(10), 'g')"
    return f"regexp_replace({x}, '\\A[ \\n]+|[ \\n]+\\z', '', 'g')"


_CRLF = "chr(13) || chr(10)"
OP1 = f"""
with responses as (
  select page_id, coalesce(url, '') as target_uri, coalesce(html, '') as payload from pages
), base as (
  select page_id, target_uri, payload,
    {_urn("concat_ws('|', 'response', coalesce(page_id::varchar, ''), target_uri, sha1(payload))")} as refers_to,
    '2024-01-01T00:00:00Z' as date,
    {_sha1_digest("payload")} as payload_digest,
    'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || octet_length(encode(payload)) || {_CRLF} as source_headers,
    coalesce(regexp_extract(payload, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '') as title,
    coalesce(regexp_extract(payload, '(?i)<html\\b[^>]*\\blang=["'']?([A-Za-z-]+)', 1), '') as language
  from responses
), blocks as (
  select *, 'metadata' as record_type, 'application/warc-fields' as content_type,
    'payload-digest: ' || payload_digest || {_CRLF} || 'payload-length: ' || octet_length(encode(payload)) || {_CRLF} || 'language: ' || language || {_CRLF} || 'title: ' || regexp_replace(title, '[\\r\\n]+', ' ', 'g') || {_CRLF} || source_headers as block
  from base
  union all
  select *, 'conversion', 'text/plain; charset=utf-8', {_plain("payload")} from base
)
select page_id, refers_to, target_uri, date, payload_digest, record_type, content_type, block,
  {_urn("concat_ws('|', record_type, refers_to)")} as record_id,
  {_sha1_digest("block")} as block_digest,
  octet_length(encode(block))::bigint as content_length
from blocks
"""


#: The records of OP1 with their headers; the source headers follow from the page whose response a record refers to.
OP1_RECORDS = f"""
with sources as (
  select distinct {_urn("concat_ws('|', 'response', coalesce(page_id::varchar, ''), coalesce(url, ''), sha1(coalesce(html, '')))")} as refers_to,
    'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || {_CRLF} as source_headers
  from pages
)
select r.*, source_headers, 'WARC/1.1' || {_CRLF} || concat('WARC-Type: ', record_type) || {_CRLF} || concat('WARC-Record-ID: ', record_id) || {_CRLF} || concat('WARC-Refers-To: ', refers_to) || {_CRLF} ||
  concat('WARC-Target-URI: ', target_uri) || {_CRLF} || concat('WARC-Date: ', date) || {_CRLF} || concat('WARC-Block-Digest: ', block_digest) || {_CRLF} ||
  concat('Content-Type: ', content_type) || {_CRLF} || concat('Content-Length: ', content_length) || {_CRLF} as warc_headers
from ({OP1}) r join sources using (refers_to)
"""


def _crc32(x: str) -> str:
    """CRC-32 of the UTF-8 bytes, by a table that is built from its rule."""
    entries = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        entries.append(str(value))
    step = f"xor(c >> 8, list_extract([{', '.join(entries)}]::bigint[], (xor(c & 255, b) + 1)::int))"
    codes = f"list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: ('0x' || h)::bigint)"
    return f"xor(list_reduce([4294967295::bigint] || {codes}, lambda c, b: {step}), 4294967295::bigint)"


def _descent(tree: sharding.HashTree, name: str) -> str:
    """CTEs that end in ``name`` (key, shard)."""
    parts, source, node = [], "keys", "0"
    for level, spans, weights in tree.levels():
        rows = ", ".join(f"({parent}, {child}, {weights[child]!r}::double)" for parent, (first, n) in enumerate(spans) for child in range(first, first + n))
        draw = f"ln((('0x' || substr(md5(concat_ws('|', k.key, '{level}', n.child::varchar)), 1, 13))::bigint + 1) / 4503599627370496.0::double) / n.weight"
        out = f"{name}_{level}"
        parts.append(f"{out} as (select k.key, arg_max(n.child, {{'d': {draw}, 'o': -n.child}}) as node from (select key, {node} as parent from {source}) k join (values {rows}) n(parent, child, weight) on n.parent = k.parent group by k.key)")
        source, node = out, "node"
    return ", ".join(parts)


def op7() -> str:
    tree = sharding.HashTree()
    return f"""
with docs as (
  select doc_id, coalesce(text, '') as body, coalesce(doc_id::varchar, 'text:' || md5(coalesce(text, ''))) as key from documents
), keys as (select distinct key from docs),
{_descent(tree, "now")}, {_descent(tree.grown(), "later")},
rows as (
  select d.doc_id, octet_length(encode(d.body))::bigint + 1 as size, {_crc32("d.body")} as text_crc32,
    a.node::int as shard, b.node::int as grown_shard, ('0x' || substr(md5(d.key), 1, 8))::bigint % 256 as chunk
  from docs d join now_shard a on a.key = d.key join later_shard b on b.key = d.key
)
select doc_id, size, text_crc32, 'key' as law, shard,
  row_number() over (partition by shard order by chunk, doc_id, text_crc32, size) - 1 as slot, grown_shard
from rows
"""


#: Shingles of whole texts; pairs that share one are compared on both sets; components by repeated least ids.
OP2 = r"""
with recursive docs as (
  select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), shingled as (
  select rid, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from docs
), sizes as (select rid, doc_id, len(s)::bigint as n from shingled),
each as (select rid, unnest(s) as shingle from shingled),
shared as (select a.rid as x, b.rid as y, count(*) as n from each a join each b on a.shingle = b.shingle and a.rid <> b.rid group by 1, 2),
links as (select x, y from shared join sizes p on p.rid = x join sizes q on q.rid = y where 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
reach(rid, other) as (
  select rid, rid from sizes union select reach.rid, links.y from reach join links on links.x = reach.other
)
select s.doc_id, s.n as n_shingles, min(o.doc_id) as component_id, s.doc_id = min(o.doc_id) as kept
from sizes s join reach on reach.rid = s.rid join sizes o on o.rid = reach.other group by s.rid, s.doc_id, s.n
"""


OP5 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
), ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""


def _op3() -> str:
    from quillmark.llm import imatch

    band = imatch.Band()
    subsets = imatch.SUBSETS
    terms = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))"

    def near(a: str, b: str) -> str:
        part = lambda x, k: f"string_split({x}, ';')[{k}]"
        level = lambda x: f"try_cast({part(x, 1)} as int)"
        side = lambda x: f"string_split(case when {level(x)} = greatest({level(a)}, {level(b)}) then {part(x, 2)} else {part(x, 3)} end, '.')"
        both = f"list_filter(list_zip({side(a)}, {side(b)}), lambda e: e[1] <> '-' or e[2] <> '-')"
        return f"case when {a} = {b} then 1.0::double when abs({level(a)} - {level(b)}) <= 1 then coalesce(len(list_filter({both}, lambda e: e[1] = e[2])) / nullif(len({both}), 0)::double, 0.0::double) else 0.0::double end"

    return f"""
with docs as (
  select row_number() over (order by doc_id nulls first, md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, ''))) as r, doc_id, coalesce(text, '') as text from documents
), total as (select count(*) as n from docs),
follow as (
  select d.*, length(d.text) as n_chars, e.text as next_text, e.r as next_r from docs d, total t join docs e on e.r = d.r % t.n + 1
), texts as (
  select r, next_r, doc_id, n_chars, text, substr(text, 1, n_chars - n_chars // 4) || substr(next_text, 1, n_chars // 4) as edited from follow
), counted as (select term, count(*) as df from (select unnest({terms.format('text')}) as term from docs) group by term),
words as (
  select term, list_transform(range({subsets}), lambda k: ('0x' || substr(md5('a' || term) || md5('b' || term), (4 * k + 1)::int, 4))::int) as draws
  from counted, total where df >= greatest(2.0, {band.low} * n) and df <= greatest(2.0, {band.high} * n)
), sides as (select r, 0 as side, text as body from texts union all select r, 1, edited from texts),
each as (select r, side, unnest({terms.format('body')}) as term from sides),
found as (select e.r, e.side, w.term, w.draws from each e join words w on w.term = e.term),
sizes as (select r, side, least({imatch.DEEPEST}, floor(log2(count(*) + 0.5)))::int as level from found group by r, side),
picked as (
  select f.r, f.side, k.k, string_agg(f.term, ' ' order by f.term) filter (where f.draws[k.k + 1] < 65536.0 / pow(2, s.level)) as wide,
    string_agg(f.term, ' ' order by f.term) filter (where f.draws[k.k + 1] < 65536.0 / pow(2, s.level + 1)) as thin
  from found f join sizes s on s.r = f.r and s.side = f.side cross join range({subsets}) k(k) group by f.r, f.side, k.k
), joined as (
  select r, side, string_agg(coalesce(substr(md5(wide), 1, 8), '-'), '.' order by k) as wide, string_agg(coalesce(substr(md5(thin), 1, 8), '-'), '.' order by k) as thin from picked group by r, side
), prints as (
  select t.r, t.side, case when s.level is null then 'terms;' || md5(array_to_string(list_sort({terms.format('body')}), ' ')) else s.level || ';' || j.wide || ';' || j.thin end as print
  from sides t left join sizes s on s.r = t.r and s.side = t.side left join joined j on j.r = t.r and j.side = t.side
)
select t.doc_id, t.n_chars::bigint as n_chars, sha256(t.edited) as edited_sha256, a.print as fingerprint, b.print as edited_fingerprint,
  {near('a.print', 'b.print')} as near_edited, {near('a.print', 'c.print')} as near_next
from texts t join prints a on a.r = t.r and a.side = 0 join prints b on b.r = t.r and b.side = 1 join prints c on c.r = t.next_r and c.side = 0
"""


OP3 = _op3()
