"""The same queries in plain SQL for DuckDB, written apart from the library."""

from __future__ import annotations

from checks.queries import BATCH_TEXTS, INDEXED, MANY_SCRUBBED, SEARCH_LIMIT, SEARCHES
from orderlake.fixtures import (
    BROKEN_LINE_SQL,
    EMPTY_ARRAY,
    NO_IMAGE,
    ORDER_LINE_SQL,
    PAGE_PATH_SQL,
    PROSE,
    UNEVEN_NAME_SQL,
)
from orderlake.schema import (
    BROWSE_COLUMNS,
    EXTRACTED_COLUMNS,
    ORDER_LINE_COLUMNS,
    SEARCH_COLUMNS,
    VERIFIED_COLUMNS,
)

_FROM = """
  from lineitem
  join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey
  join part on l_partkey = p_partkey"""


def _raw(name: str = "raw", names: str | None = None) -> str:
    exprs = {**ORDER_LINE_SQL, **({"Customer_Name": names} if names else {})}
    columns = ", ".join(f"{sql} as {c}" for c, sql in exprs.items())
    return f"{name} as (select {columns}, l_orderkey, l_linenumber, l_partkey {_FROM})"


def _clean(c: str) -> str:
    return f"coalesce(cast(cast(trunc(try_cast({c} as double)) as bigint) as varchar), '')"


def _canonical(code: str, desc: str) -> dict[str, str]:
    s = f"upper({code} || ' ' || {desc})"
    family = (
        f"case when regexp_matches({s}, 'SAMP|SMPL|SIMPLER') then 'SAMP' "
        f"when regexp_matches({s}, 'CAR|CRAV') then 'CARM' "
        f"when regexp_matches({s}, '^MG|GUM|GALACTIC|GLM') then 'GUMM' "
        f"when regexp_matches({s}, 'CHO|BAR|HERO|HERB|MUSH|MMB|MMC') then 'CHOC' else 'ASST' end"
    )
    dash, last = (
        f"regexp_extract({code}, '-([0-9])([^0-9]|$)', 1)",
        f"regexp_extract({code}, '([0-9])\\s*$', 1)",
    )
    tier = (
        f"case when {dash} in ('1','3','5') then {dash} "
        f"when {last} in ('1','3','5') then {last} else '1' end"
    )
    tiered = f"({family}) in ('CARM','GUMM','CHOC')"
    name = (
        f"case {family} when 'CARM' then 'Signature Caramels' when 'GUMM' then 'Botanical Gummies' "
        "when 'CHOC' then 'Dark Chocolate Bar' when 'SAMP' then 'Sampler Pack' "
        "else 'Assorted Selection' end"
    )
    return {
        "Product_Code": f"case when {tiered} then ({family}) || '-' || ({tier}) else ({family}) end",
        "Product_Description":
            f"case when {tiered} then ({name}) || ' — ' || ({tier}) || '-Pack' else ({name}) end",
        "Category": f"case {family} when 'CARM' then 'Caramels' when 'GUMM' then 'Gummies' "
                    "when 'CHOC' then 'Chocolate' when 'SAMP' then 'Sampler' else 'Assorted' end",
    }


_CAT = _canonical("Product_Code", "Product_Description")
_MONEY = "try_cast({0} as decimal(18,4))"
_DATE = "cast(try_strptime(Date, '%m/%d/%Y') as date)"

# Order lines with a clean number, and the silver lines the reports start from.
_LINES = f"{_raw()}, lines as (select * replace ({_clean('Order_Number')} as Order_Number) from raw)"
_SILVER = f"""{_LINES}, silver as (
  select Ingest_Key, Order_Number, Customer_Name, Shipping_State, {_DATE} as Date_parsed,
    {_CAT['Product_Code']} as Product_Code, {_CAT['Product_Description']} as Product_Description,
    {_CAT['Category']} as Category, {_MONEY.format('Total_Amount')} as Total_Amount
  from lines)"""
_ORDERS = f"""{_SILVER}, ord as (
  select * from silver where Order_Number <> ''
  qualify row_number() over (partition by Order_Number order by Ingest_Key) = 1)"""
_MEMBERS = f"""{_ORDERS}, members as (
  select Customer_Name, count(distinct Order_Number) as orders,
    coalesce(cast(sum(Total_Amount) as double), 0.0) as spent
  from ord group by Customer_Name)"""
_SEGMENT = ("case when orders = 1 then 'One-time' when orders <= 3 then 'Repeat (2-3)' "
            "when orders <= 6 then 'Loyal (4-6)' else 'VIP (7+)' end")

_COLS = ", ".join(ORDER_LINE_COLUMNS)
_KEYED = f"Ingest_Key, {_COLS}"


def _document(number: str = "Order_Number") -> str:
    fields = [number if c == "Order_Number" else c for c in SEARCH_COLUMNS]
    return "concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in fields) + ")"


def _any_match(pattern: str) -> str:
    return "(" + " or ".join(f"regexp_matches(lower({c}), '{pattern.lower()}')" for c in SEARCH_COLUMNS) + ")"


def _tier(q: str) -> str:
    low = q.lower()
    exact = ""
    if q.isdigit():
        exact += f"when Order_Number = '{q}' then -2 "
    if "@" in q:
        exact += f"when Email = '{q}' then -1 "
    return (
        f"case {exact}when not {_any_match(q)} then null "
        f"when lower(Order_Number) = '{low}' then 0 "
        f"when regexp_matches(lower(Order_Number), '{low}') then 1 else 2 end"
    )


def _ranked(q: str, columns: str, limit: int = SEARCH_LIMIT) -> str:
    return f"""
      select {columns} from (
        select *, row_number() over (order by tier, Ingest_Key) as Rank, min(tier) over () as best
        from (select *, {_tier(q)} as tier from lines) where tier is not null)
      where Rank <= {limit} and (best >= 0 or tier = best)"""


# Pages: slips and documents, with the route and what the rule-based reader says.
_WHITE = " || ".join(
    f"chr({n})" for n in [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203),
                          8232, 8233, 8239, 8287, 12288]
)
_SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
_NOSPACE = r"[^\t-\r\x1c-\x1f\x{85}\p{Z}]"
_SLIP = "concat_ws(chr(10), 'Packing slip', " + ", ".join(
    f"'{c.replace('_', ' ')}: ' || {c}" for c in EXTRACTED_COLUMNS) + ")"
_ANSWER = f"case when {PROSE} then 'Sorry, I cannot read this order.' when {EMPTY_ARRAY} then '[]' end"
_PAGES = f"""{_raw()}, pages_in as (
  select *, {PAGE_PATH_SQL} as path, cast(l_linenumber - 1 as int) as page_index,
    case l_orderkey % 3
      when 0 then {_SLIP} || coalesce(chr(10) || 'Answer: ' || ({_ANSWER}), '')
      when 1 then ' order ' || Order_Number
      else 'order for customer, see the attached sheet for everything else ' ||
        case when l_linenumber % 2 = 0 then 'or write to desk@example.com' else 'or ask at the desk' end
    end as text, not ({NO_IMAGE}) as has_image, l_orderkey % 3 <> 2 or l_linenumber % 2 = 1 as slip
  from raw
  union all by name
  select 'inbox/documents/' || doc_id || '.txt' as path, 0 as page_index, text,
    false as has_image, false as slip from documents),
measured as (
  select *, trim(text, {_WHITE}) as stripped from pages_in),
judged as (
  select *, lower(stripped) as low,
    length(stripped) >= 50 and length(regexp_replace(stripped, '{_SPACE}+', ' ', 'g')) >= 30 as long_enough,
    regexp_matches(text, '\\$\\p{{Nd}}+\\.?\\p{{Nd}}*')
      or regexp_matches(text, '\\p{{Nd}}{{1,2}}[/-]\\p{{Nd}}{{1,2}}[/-]\\p{{Nd}}{{2,4}}')
      or regexp_matches(text, '{_NOSPACE}+@{_NOSPACE}+\\.{_NOSPACE}+') as has_value
  from measured),
counted as (
  select *, {' + '.join(f"cast(contains(low, '{w}') as int)" for w in
    ('order', 'customer', 'total', 'product', 'quantity', 'price', 'email', 'date'))} as words
  from judged),
routed as (
  select *, coalesce(long_enough and (words >= 3 or (words >= 2 and has_value)), false) as sufficient,
    string_split(path, '/')[-1] as File, cast(page_index + 1 as varchar) as Page from counted),
seen as (
  select *, case when sufficient then 'text' when has_image then 'image' else 'none' end as route
  from routed),
read as (
  select *, case when route = 'none' then null when not slip then 'There is no order on this page.'
    else {_ANSWER} end as answer from seen),
log as (
  select *, case when route = 'none' then 'no_image' when answer = '[]' then 'empty'
    when answer is not null then 'unparsed' else 'ok' end as status from read)"""

_RECORDS = f"""with {_PAGES}
select route, {', '.join(EXTRACTED_COLUMNS)}, File as Source_File, Page as Source_Page
from log where status = 'ok'"""

# Responses with planted faults, one page a line.
_BARE = ("Order_Number", "Customer_Name", "Quantity")
_bare_values = {"Quantity": "'2'"}
_PARSED = f"""{_raw()}, paged as (
  select *, string_split({PAGE_PATH_SQL}, '/')[-1] as File, Source_Page as Page,
    l_orderkey % 20 as plant from raw),
parsed as (
  select File, Page, l_partkey, 'ok' as status, 0 as line_no, true as may_verify,
    {', '.join(EXTRACTED_COLUMNS)} from paged where plant = 0 or plant > 7
  union all
  select File, Page, l_partkey, 'ok', case when plant = 7 then 0 else 1 end, false,
    {', '.join(_bare_values.get(c, c) if c in _BARE else 'null' for c in EXTRACTED_COLUMNS)}
  from paged where plant = 0 or plant >= 7
  union all
  select File, Page, l_partkey, case when plant = 4 then 'empty' else 'unparsed' end, null, false,
    {', '.join('null' for _ in EXTRACTED_COLUMNS)} from paged where plant between 1 and 6)"""

_p = "l_partkey % 7"
_VERIFIED = {
    "Customer_Name": f"case when {_p} in (0, 1) then Customer_Name else upper(Customer_Name) end",
    "Email": f"case when {_p} = 2 or Email = '' then Email else upper(Email) end",
    "Shipping_City": f"case when {_p} = 3 then Shipping_City else upper(Shipping_City) end",
    "Shipping_Zip": "substr(Shipping_Zip, 1, 5)",
}


def _merged(c: str) -> str:
    if c not in VERIFIED_COLUMNS or c not in _VERIFIED:
        return c
    return f"case when may_verify and {_p} <> 5 then {_VERIFIED[c]} else {c} end as {c}"


_KEY = f"lower(trim(Customer_Name, {_WHITE}))"
_NAMES = _raw("names", UNEVEN_NAME_SQL)
_AUDIT = f"""with {_NAMES},
counts as (select count(*) as lines, count(distinct {_KEY}) as customers,
  count(distinct nullif({_KEY}, '')) as named, count(distinct nullif(Email, '')) as emails from names)
select rule as "check", n as checked, true as passed from (
  select 'customers_kept' as rule, customers as n from counts
  union all select 'identity_one_to_one', customers from counts
  union all select 'emails_unique', customers from counts
  union all select 'lines_and_orders_kept', lines from counts
  union all select 'no_real_name_left', named from counts
  union all select 'no_real_email_left', emails from counts
  union all select 'zip_area_only', lines from counts
  union all select 'line2_blank', lines from counts
  union all select 'other_columns_kept', lines from counts
  union all select 'first_lines_kept', count(distinct nullif(Order_Number, '')) from names)"""


def _scrubbed(c: str) -> str:
    return f"replace(replace({c}, 'ACME', 'sample-scan'), 'BUILDING', 'sample-scan')"


_ANON = {
    "Customer_Name": "'Member ' || digest",
    "Email": "case when trim(Email) <> '' then digest || '@example.org' else Email end",
    "Shipping_Address_Line1": "'1 ' || digest || ' Rd'",
    "Shipping_Address_Line2": "''",
    "Shipping_Zip": "substr(regexp_replace(Shipping_Zip, '[^0-9]', '', 'g'), 1, 3)",
    "Product_Code": _CAT["Product_Code"],
    "Product_Description": _CAT["Product_Description"],
}

_STORED = ", ".join(f"{c} as {c.lower()}" for c in ORDER_LINE_COLUMNS if c != "Order_Number")


def _stored(source: str = "raw") -> str:
    return (f"select Ingest_Key, {_document()} as document, "
            f"{_clean('Order_Number')} as order_number, {_STORED} from {source}")


_FIXED = "Date = 'illegible'"
_UPDATED_NUMBER = f"case when {_FIXED} then {_clean(chr(39) + '00' + chr(39) + ' || Order_Number')} else {_clean('Order_Number')} end"

ORACLES = {
    "conform": f"with {_raw()} select * replace ('' as Service_Fee) from (select {_KEYED} from raw)",
    "rename_display": f"with {_LINES} select {_COLS} from lines",
    "browse": f"with {_LINES} select {', '.join(BROWSE_COLUMNS)} from lines",
    "search_document": f"with {_raw()} select Ingest_Key, {_document()} as document from raw",
    "provenance": f"with {_PAGES} select path, File as Source_File, Page as Source_Page from routed",
    "scan_limit": f"with {_LINES} select {_KEYED} from lines order by Ingest_Key limit {SEARCH_LIMIT}",
    "typed_lines": f"""with {_LINES} select {_KEYED}, {_DATE} as Date_parsed,
        case split_part(Product_Code, '-', 1) when 'CARM' then 'Caramels' when 'GUMM' then 'Gummies'
          when 'CHOC' then 'Chocolate' when 'SAMP' then 'Sampler' when 'ASST' then 'Assorted'
          else 'Other' end as Category
      from (select * replace (
        {', '.join(f"cast({_MONEY.format(c)} as double) as {c}" for c in
                   ('Unit_Price', 'Extended_Price', 'Total_Amount', 'Sub_Total'))},
        try_cast(Quantity as double) as Quantity) from lines)""",
    "clean_order_number":
        f"with {_raw()} select Ingest_Key, Order_Number, {_clean('Order_Number')} as clean from raw",
    "reclean_count": f"""with {_raw()}
      select 'first' as run, count(*) as changed from raw where {_clean('Order_Number')} <> Order_Number
      union all select 'second', cast(0 as bigint)""",
    "zip_prefix": f"""with {_raw()} select Ingest_Key,
      substr(regexp_replace(Shipping_Zip, '[^0-9]', '', 'g'), 1, 3) as zip_area from raw""",
    "token_scrub": f"""with {_raw()} select Ingest_Key,
      {', '.join(f"{_scrubbed(c)} as {c}" for c in ORDER_LINE_COLUMNS)} from raw""",
    "token_scrub_many": f"""with {_raw()}, words as (
        select p_name as token from part union select unnest(string_split(p_name, ' ')) from part
        union select p_brand from part union select c_mktsegment from customer union select n_name from nation),
      tokens as (select list(token order by token) as ts from words)
      select Ingest_Key, {', '.join(
          f"list_reduce(ts, lambda x, y: replace(x, y, 'sample-scan'), {c}) as {c}" for c in MANY_SCRUBBED)}
      from raw, tokens""",
    "customer_key": f"""with {_NAMES} select {_KEY} as cust_key, count(*) as lines,
      arg_min(Customer_Name, Ingest_Key) as first_spelling from names group by 1""",
    "category": f"with {_SILVER} select Ingest_Key, Product_Code, Category from silver",
    "canonical_products": f"""with {_SILVER}
      select Product_Code, Product_Description, Category, count(*) as line_items
      from silver group by all""",
    "order_level": f"""with {_ORDERS} select Ingest_Key, Order_Number, Customer_Name, Shipping_State,
      Date_parsed, cast(Total_Amount as double) as Total_Amount from ord""",
    "kpis": f"""with {_ORDERS} select (select count(*) from ord) as orders,
      (select count(*) from silver) as line_items,
      (select count(distinct Customer_Name) from silver) as members,
      (select cast(sum(Total_Amount) as double) from ord) as revenue""",
    "category_mix": f"with {_SILVER} select Category, count(*) as line_items from silver group by 1",
    "revenue_by_month": f"""with {_ORDERS}
      select cast(date_trunc('month', Date_parsed) as date) as Month,
        coalesce(cast(sum(Total_Amount) as double), 0.0) as revenue
      from ord where Date_parsed is not null group by 1""",
    "top_products": f"""with {_SILVER}
      select Product_Code, Product_Description, count(*) as line_items, any_value(Category) as Category
      from silver group by 1, 2
      order by line_items desc, Product_Code, Product_Description limit 8""",
    "customer_value": f"with {_MEMBERS} select *, {_SEGMENT} as Type from members",
    "loyalty_kpis": f"""with {_MEMBERS}
      select avg(case when orders > 1 then 1.0::double else 0.0::double end) * 100 as repeat_rate,
        avg(cast(orders as double)) as mean_orders,
        count(*) filter (orders >= 4) as members_4_plus from members""",
    "loyalty_segments": f"""with {_MEMBERS}
      select Segment, count(Type) as Members
      from (values ('One-time'), ('Repeat (2-3)'), ('Loyal (4-6)'), ('VIP (7+)')) s(Segment)
      left join (select {_SEGMENT} as Type from members) on Type = Segment group by 1""",
    "orders_by_state": f"""with {_ORDERS} select Shipping_State, count(*) as Orders
      from ord where length(Shipping_State) = 2 group by 1""",
    "summary_stats": f"""with {_LINES} select count(*) as total_records,
      count(distinct nullif(Order_Number, '')) as unique_orders,
      count(distinct Customer_Name) as unique_customers,
      min({_DATE}) as earliest, max({_DATE}) as latest,
      min(Date) as earliest_text, max(Date) as latest_text from lines""",
    "summary_top_products": f"""with {_LINES} select Product_Code, count(*) as records
      from lines group by 1 order by records desc, Product_Code limit 5""",
    "summary_sources":
        f"with {_LINES} select Source_File, count(*) as records from lines group by 1",
    "order_totals": f"""with {_LINES}, amounts as (
        select Order_Number, Ingest_Key, {_MONEY.format('Service_Fee')} as fee,
          {_MONEY.format('Shipping')} as ship, {_MONEY.format('Total_Amount')} as stated,
          try_cast(Quantity as decimal(18,4)) * {_MONEY.format('Unit_Price')} as amount from lines
        where Order_Number <> ''),
      per_order as (
        select Order_Number, count(*) as lines, cast(coalesce(sum(amount), 0) as decimal(28,4)) as subtotal,
          arg_min(fee, Ingest_Key) as fee, arg_min(ship, Ingest_Key) as ship,
          (arg_min(struct_pack(v := stated), Ingest_Key)).v as stated
        from amounts group by 1),
      totals as (select *, subtotal + coalesce(fee, 0) + coalesce(ship, 0) as total from per_order)
      select Order_Number, lines, cast(subtotal as double) as subtotal, cast(total as double) as total,
        cast(stated as double) as stated_total, coalesce(total = stated, false) as reconciled
      from totals""",
    "filter_equality": f"""with {_LINES} select {_KEYED} from lines
      where Shipping_State = 'AZ' and Product_Code = 'CARM-5'""",
    "search_exact_order": f"with {_LINES} {_ranked('12', _KEYED)}",
    "search_email": f"with {_LINES} {_ranked(SEARCHES[2], _KEYED)}",
    "search_text": f"with {_LINES} select {_KEYED} from lines where {_any_match('Ring|CITY 2')}",
    "search_literal": f"""with {_LINES} select {_KEYED} from lines where
      {' or '.join(f"contains(lower({c}), 'city 1')" for c in SEARCH_COLUMNS)}""",
    "search_ranked": f"with {_LINES} " + " union all ".join(
        _ranked(q, f"{_KEYED}, '{q}' as Query, Rank") for q in SEARCHES),
    "search_indexed": f"with {_LINES} " + " union all ".join(
        f"select Ingest_Key, '{q}' as Query from lines where " + (
            _any_match(q) if mode == "regex" else " or ".join(f"contains(lower({c}), '{q.lower()}')" for c in SEARCH_COLUMNS))
        for q, mode in INDEXED),
    "search_batch": f"with {_LINES} " + " union all ".join([
        *(f"""select Ingest_Key, {c} as Query, row_number() over (partition by {c} order by Ingest_Key) as Rank
          from lines where {c} <> '' qualify Rank <= 3""" for c in ("Order_Number", "Email")),
        *(_ranked(q.strip(), f"Ingest_Key, '{q.strip()}' as Query, Rank", 3) for q in BATCH_TEXTS if q)]),
    "search_count": f"with {_LINES} select count(*) as matches from lines where {_any_match('ring')}",
    "vector_topk": """with means as (
        select label, i, avg(cast(embedding[i] as double)) as m
        from embeddings, range(1, 65) t(i) group by label, i),
      asked as (select label, list(m order by i) as q from means group by label),
      scored as (
        select a.label, vec_id, list_cosine_similarity(cast(embedding as double[]), q) as score
        from embeddings, asked a),
      ranked as (
        select *, row_number() over (partition by label order by score desc, vec_id) as rank from scored)
      select cast(label as bigint) as query_id, rank, vec_id, round(score, 6) as score
      from ranked where rank <= 10""",
    "vector_topk_many": """with unit as (select vec_id, cast(embedding as double[]) as v from embeddings),
      scored as (select q.vec_id as query_id, u.vec_id, list_cosine_similarity(q.v, u.v) as score from unit q, unit u),
      ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
      select query_id, count(*) as found, round(min(score), 5) as least, round(sum(score), 4) as total
      from ranked where rank <= 5 group by 1""",
    "csv_roundtrip": f"with {_raw()} select {_COLS} from raw",
    "csv_split_read": f"""with {_raw()} select {_COLS} from (
      select * replace ({BROKEN_LINE_SQL} as Shipping_Address_Line2) from raw)""",
    "store_rebuild": f"with {_raw()} {_stored()}",
    "store_append": f"""with {_raw()} {_stored("raw where Shipping_State <= 'IL'")}
      union all {_stored('''(select * replace ('late batch.pdf' as Source_File) from raw
        where Shipping_State > 'IL')''')}""",
    "store_update": f"""with {_raw()}, changed as (
        select * replace (
          {_UPDATED_NUMBER} as Order_Number,
          case when {_FIXED} then Ship_Date else Date end as Date),
          Order_Number as old_number, {_FIXED} as hit from raw)
      select Ingest_Key, case when hit then {_document()} else {_document('old_number')} end as document,
        Order_Number as order_number, {_STORED} from changed""",
    "store_delete": f"with {_raw()} {_stored('raw')} where Email <> ''",
    "text_sufficiency": f"with {_PAGES} select path, sufficient from routed",
    "page_routing":
        f"with {_PAGES} select File as Source_File, Page as Source_Page, route from seen",
    "page_range":
        f"with {_PAGES} select path, page_index from pages_in where page_index >= 1 and page_index < 4",
    "page_source": f"with {_PAGES} select path, page_index from pages_in where page_index >= 2",
    "extract_records": _RECORDS,
    "extract_counters": f"""with {_PAGES} select route, status, count(*) as pages,
      count(*) filter (status = 'ok') as records from log group by 1, 2""",
    "quarantine": f"""with {_PAGES} select File as Source_File, Page as Source_Page, route, status,
      answer as response from log where status <> 'ok'""",
    "parse_responses": f"""with {_PARSED} select File as Source_File, Page as Source_Page, status,
      line_no, may_verify, {', '.join(EXTRACTED_COLUMNS)} from parsed""",
    "verify_merge": f"""with {_PARSED} select File as Source_File, Page as Source_Page, line_no,
      {', '.join(_merged(c) for c in EXTRACTED_COLUMNS)} from parsed where status = 'ok'""",
    "stream_extract": _RECORDS,
    "run_extraction": _RECORDS,
    "stream_restart": _RECORDS,
    "store_reload": f"with {_raw()} select * exclude (Ingest_Key) from ({_stored()})",
    "import_counters": f"""with {_raw()}, {_NAMES},
      counts as (select count(*) as n, count(*) filter (Shipping_State <= 'IL') as early from raw)
      select 'rebuild' as step, early as n from counts union all select 'append', n - early from counts
      union all select 'lines_read', n from counts union all select 'lines_written', n from counts
      union all select 'customers', count(distinct {_KEY}) from names""",
    "anonymize_rules": f"""with {_NAMES}, keyed as (select *, md5({_KEY}) as digest from names)
      select Ingest_Key, {', '.join(f"{_scrubbed('(' + _ANON.get(c, c) + ')')} as {c}"
                                    for c in ORDER_LINE_COLUMNS)} from keyed""",
    "anonymize_audit": _AUDIT,
    "anonymize_job": f"""with {_ORDERS}
      select cast(date_trunc('month', Date_parsed) as date) as Month,
        coalesce(cast(sum(Total_Amount) as double), 0.0) as revenue
      from ord where Date_parsed is not null group by 1""",
    "lookup_by_id": f"""with {_ORDERS} select * from ({_stored()})
      where Ingest_Key in (select Ingest_Key from ord)""",
    "private_mapping": f"""with {_NAMES} select arg_min(Customer_Name, Ingest_Key) as real_name,
      true as own_name, true as has_email from names group by {_KEY}""",
    "source_quality": f"""with {_NAMES} select count(*) as lines,
      count(*) filter ({_clean('Order_Number')} = '') as unusable_order_numbers,
      count(*) filter (length(regexp_replace(Shipping_Zip, '[^0-9]', '', 'g')) = 4) as four_digit_zips
      from names""",
}

# The same figures from tables that were brought up to date.
ORACLES |= {
    "refresh_kpis": ORACLES["kpis"],
    "refresh_customer_value": ORACLES["customer_value"],
    "refresh_summary": ORACLES["summary_stats"],
}
