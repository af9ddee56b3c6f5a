"""Schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

TEXT, INT, LONG, FLAG = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
#: Models grade with fractions too.
SCORE = T.DoubleType()
TIME, DAY, REAL = T.TimestampType(), T.DateType(), T.DoubleType()
TEXTS = T.ArrayType(TEXT)


def row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(row(**fields))


PAGES = rows(url=TEXT, page_type=TEXT, text=TEXT, chars=INT, low_content=FLAG, source_type=TEXT)
PEOPLE = rows(name=TEXT, title=TEXT)
CONTACTS = rows(
    email=TEXT, role=TEXT, matched_name=TEXT, matched_title=TEXT, source=TEXT, verification=TEXT,
    verification_note=TEXT, confidence=TEXT, linkedin_lookup_url=TEXT,
)
EVENTS = rows(event=TEXT, quote=TEXT, source_url=TEXT)
PAINS = rows(pain=TEXT, quote=TEXT, source_url=TEXT, confidence=SCORE)
HOOKS = rows(hook=TEXT, quote=TEXT, source_url=TEXT, specificity=SCORE)

CRAWL_RESULT = row(
    domain=TEXT, crawled_at=TIME, status=TEXT, pages=PAGES, emails=TEXTS, team_members=PEOPLE, total_chars=INT,
    duration_sec=REAL, error=TEXT, blocked_pages=TEXTS, robots_skipped=TEXTS,
)
CONTACTS_RESULT = row(domain=TEXT, processed_at=TIME, status=TEXT, contacts=CONTACTS, smtp_probing_enabled=FLAG)
ANALYSIS_FIELDS = row(
    company_name=TEXT, what_they_do=TEXT, icp_they_serve=TEXT, services=TEXTS, geo=TEXT, size_estimate=TEXT,
    recent_events=EVENTS, hiring_signals=TEXTS, tech_signals=TEXTS, pains=PAINS, hooks=HOOKS, disqualifiers=TEXTS,
)
ANALYSIS = T.StructType(
    row(domain=TEXT, status=TEXT, signal_gate=TEXT).fields
    + ANALYSIS_FIELDS.fields
    + row(quotes_dropped=INT, error=TEXT).fields
)
DRAFT_ITEMS = rows(step=INT, subject=TEXT, body=TEXT)
JUDGE_SCORES = row(grounding=SCORE, specificity=SCORE, peer_tone=SCORE, would_reply=SCORE, overall=SCORE, feedback=TEXT)
SENTIMENT = row(sentiment=TEXT, confidence=SCORE, reasoning=TEXT)
OFFER = row(
    your_company_name=TEXT, sender_name=TEXT, what_you_sell=TEXT, icp_description=TEXT, cta_style=TEXT,
    proof_points=rows(claim=TEXT, detail=TEXT), example_emails=rows(subject=TEXT, body=TEXT),
)
QUEUE_ITEM = row(
    to_email=TEXT, to_name=TEXT, subject=TEXT, body=TEXT, step=INT, domain=TEXT, _self_check_failed=FLAG,
    _violations=TEXTS,
)
MAILBOX = row(
    name=TEXT, smtp_user=TEXT, reply_to=TEXT, from_name=TEXT, warmup_start_date=DAY, daily_cap_override=INT
)
FEW_SHOT = row(domain=TEXT, company_name=TEXT, subject=TEXT, grounding=TEXT, reply_text=TEXT)

LEADS = row(
    email=TEXT, domain=TEXT, name=TEXT, sequence_step=INT, status=TEXT, last_sent_at=TIME, next_send_at=TIME,
    created_at=TIME, updated_at=TIME, meeting_booked_at=TIME,
)
SUPPRESSION = row(value=TEXT, scope=TEXT, reason=TEXT, suppressed_at=TIME)
SEND_LOG = row(
    id=LONG, email=TEXT, step=INT, subject=TEXT, message_id=TEXT, mailbox=TEXT, sent_at=TIME, status=TEXT, error=TEXT
)
MAILBOX_DAILY_COUNTS = row(mailbox=TEXT, day=DAY, count=LONG)
REPLIES = row(
    id=LONG, email=TEXT, step=INT, subject=TEXT, body_text=TEXT, received_at=TIME, sentiment=TEXT,
    sentiment_confidence=SCORE, classified_at=TIME,
)
PROCESSED_REPLIES = row(uid=TEXT, processed_at=TIME, classification=TEXT)
INBOUND = row(uid=TEXT, from_addr=TEXT, subject=TEXT, body=TEXT, full_text=TEXT, received_at=TIME)
STATE_TABLES = {
    "leads": LEADS, "suppression": SUPPRESSION, "send_log": SEND_LOG,
    "mailbox_daily_counts": MAILBOX_DAILY_COUNTS, "replies": REPLIES, "processed_replies": PROCESSED_REPLIES,
}
