"""Modality inputs derived from the given tables by SQL that Spark and DuckDB both run.

The tables have no domain words, so reports, calls, frames and pages are made of their rows. A fixture may use others.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Name to SQL, or to a pair (Spark SQL, DuckDB SQL) where the engines differ.
FIXTURES: dict[str, str | tuple[str, str]] = {
    "posts": """
        select doc_id, cast(doc_id as string) as tweet_id, case when doc_id % 9 = 0 then 'Unknown' else source end as screen_name,
               concat(case when doc_id % 4 = 0 then 'RT ' else '' end, '@u', cast(doc_id % 7 as string), ' #', lang, ' ',
                      text, ' &amp; http://t.example/', cast(doc_id as string)) as raw_text
        from documents""",
    "sentiments": """
        select cast(doc_id as string) as tweet_id, case when toxic = 1 then 'negative' when doc_id % 5 = 0 then 'positive' else 'neutral' end as label
        from labels""",
    "topic_scores": (
        """select cast(vec_id as string) as tweet_id, i as pos, abs(cast(e as double)) * 2 as score
           from (select vec_id, e, p + 1 as i from embeddings lateral view posexplode(embedding) q as p, e) z where i <= 6""",
        """select cast(vec_id as string) as tweet_id, i as pos, abs(cast(e as double)) * 2 as score
           from (select vec_id, unnest(embedding) as e, generate_subscripts(embedding, 1) as i from embeddings) z where i <= 6""",
    ),
    "text_reports": """
        select doc_id, concat('TXT_', cast(doc_id as string)) as Text_ID, case when doc_id % 9 = 0 then 'CrimeReport' else concat('@', source) end as Source,
               text as Raw_Text, case doc_id % 4 when 0 then 'Negative' when 1 then 'Neutral' when 2 then 'Positive' else ' unknown ' end as Sentiment,
               case doc_id % 5 when 0 then 'None' when 1 then concat('Town ', lang, ' (Location); Monday (Date); Port (Location); Town ', lang, ' (Location)')
                               when 2 then 'Ann Lee (Person)' else concat(source, ' (Location)') end as Entities,
               case doc_id % 3 when 0 then 'Theft / Robbery' when 1 then 'Other' else 'Assault / Violence' end as Topic
        from documents""",
    "video_reports": """
        select event_id, concat('00:', lpad(cast(event_id % 60 as string), 2, '0'), ':07') as Timestamp, concat('FRM_', lpad(cast(user_id % 9000 as string), 4, '0')) as Frame_ID,
               case event_id % 3 when 0 then 'Person Walking' when 1 then 'Unidentified Motion' else concat(' ', event_type, '  seen ') end as Event_Detected,
               case event_id % 7 when 0 then 'none' else concat('1 person, ', cast(event_id % 3 as string), ' car') end as Objects,
               cast(event_id % 101 as double) / 100 as Confidence
        from events""",
    "audio_reports": """
        select conv_id, concat('C', cast(conv_id as string)) as Call_ID, text as Transcript, case conv_id % 3 when 0 then 'Crime/Assault' else 'Emergency Report' end as Extracted_Event,
               case conv_id % 4 when 0 then 'Unknown Location' else concat('Hall ', cast(conv_id % 9 as string)) end as Location,
               case conv_id % 3 when 0 then 'Distressed' else 'Calm' end as Sentiment, case conv_id % 3 when 0 then 0.85 else 0.4 end as Urgency_Score
        from (select conv_id * 1000 + turn as conv_id, text from conversations) c""",
    "pdf_reports": """
        select page_id, concat('RPT_', cast(page_id as string)) as Report_ID, case page_id % 4 when 0 then 'Letter' when 1 then ' MEMORANDUM' when 2 then 'Cover Letter' else null end as Incident_Type,
               case page_id % 3 when 0 then '2014-07-04' else 'N/A' end as Date, url as Location, case page_id % 2 when 0 then 'Ann Lee' else '' end as Officer,
               html as Summary
        from pages""",
    "image_reports": """
        select o_orderkey, concat('IMG_', cast(o_orderkey as string)) as Image_ID, case o_orderkey % 3 when 0 then 'Fire Scene' when 1 then 'Smoke Scene' else 'Unknown' end as Scene_Type,
               case o_orderkey % 2 when 0 then 'none' else 'car, person' end as Objects_Detected, o_orderpriority as Text_Extracted, cast(o_orderkey % 100 as double) / 100 as Confidence_Score
        from orders""",
    "incidents": """
        select *, case when Severity_Score < 3 then 'Low' when Severity_Score < 7 then 'Medium' else 'High' end as Severity_Level
        from (select event_id as ordinal, concat('INC-', cast(event_id as string)) as Incident_ID,
                     case event_id % 5 when 0 then 'Audio' when 1 then 'PDF' when 2 then 'Image' when 3 then 'Video' else 'Text' end as Source,
                     concat('R', cast(user_id as string)) as Source_Record_ID,
                     case when event_id % 11 = 0 then 'N/A' when event_id % 29 = 0 then null else concat(event_type, ' ', cast(user_id % 17 as string)) end as Event,
                     case user_id % 3 when 0 then 'N/A' else concat('Place ', cast(user_id % 23 as string)) end as Location,
                     'N/A' as Time, cast((event_id * 37 + user_id) % 101 as double) / 10 as Severity_Score,
                     concat('Objects: ', event_type, ' ', cast(event_id % 100 as string)) as Details from events) q""",
    "calls": """
        select conv_id, case conv_id % 8 when 0 then '' when 1 then 'ok' when 2 then concat(text, ' there is smoke') when 3 then concat(text, ' he has a gun')
                        when 4 then concat(text, ' a car crash on the highway') when 5 then text when 6 then concat('the blocopia bank was robbed ', text)
                        else concat('fire at the Nelson Building ', text) end as transcript,
               case conv_id % 5 when 0 then 'PERSON' when 1 then 'GPE' when 2 then 'ORG' else null end as label, case conv_id % 2 when 0 then 'sheriff''s o-brien hall' else 'FORT smith' end as place
        from (select conv_id * 1000 + turn as conv_id, text from conversations) c""",
    "frames": """
        select concat(case user_id % 6 when 0 then 'Fight_' when 1 then 'Walk_' when 2 then 'Fall_' when 3 then 'Rest_' when 4 then 'Meet_' else 'Browse_' end, cast(user_id as string)) as clip,
               cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as frame_idx,
               cast(case user_id % 3 when 0 then 0 when 1 then 25 else 30 end as double) as fps, value * 20 as motion_area, event_id
        from events""",
    "detections": """
        select event_id, k as det_idx, case (event_id + k) % 5 when 0 then 'bird' when 1 then 'dog' when 2 then 'car' else 'person' end as label,
               cast((event_id * 7 + k * 13) % 100 as double) / 100 as conf
        from events cross join (select 0 as k union all select 1 union all select 2) n where k < event_id % 4""",
    "frame_detections_in": "select f.clip, f.frame_idx, d.det_idx, d.label, d.conf from frames f join detections d on f.event_id = d.event_id",
    "pixels": """
        select l_orderkey % 500 as image_id, cast(l_partkey % 180 as int) as h, cast(l_suppkey * 7 % 256 as int) as s, cast(cast(l_quantity as int) * 5 as int) as v
        from lineitem""",
    "image_pixels": """
        select cast(floor(l_orderkey / 50) as bigint) as image_id, cast(l_partkey % 180 as int) as h, case when l_linenumber = 5 then null else cast(l_suppkey * 7 % 256 as int) end as s, case when l_orderkey % 97 = 0 then null else cast(cast(l_quantity as int) * 5 as int) end as v
        from lineitem""",
    "image_detections": """
        select o_orderkey % 500 as image_id, case o_orderkey % 6 when 0 then 'person' when 1 then 'car' when 2 then 'cat' when 3 then 'knife' when 4 then 'bus' else 'tree' end as label,
               cast(o_custkey % 100 as double) / 100 as conf from orders""",
    "fire_detections": """
        select o_orderkey % 500 as image_id, case when o_orderkey % 2 = 0 then null else 'fire' end as cls, case when o_orderkey % 7 = 0 then null else cast(o_custkey % 64 as double) / 100 end as conf
        from orders""",
    "ocr_raw": "select image_id, concat('  no ', chr(10), chr(9), 'entry ', cast(image_id as string), '  ') as raw_text from (select distinct l_orderkey % 500 as image_id from lineitem) q",
    "bundle_pages": """
        select bundle_id, page, method, conf,
               concat(replace(case page % 13 when 1 then 'MEMORANDUM~TO: Unit~FROM: Desk~' when 2 then 'Dear Sir,~' when 4 then 'Invoice # 77~' when 6 then 'AIRCRAFT REQUEST~'
                                             when 7 then 'AIRCRAFT REQUEST~' when 9 then 'COURSE OUTLINE~' else '' end, '~', chr(10)),
                      text,
                      replace(case when page % 13 = 10 then '~Lesson plan~Lesson title: x' else '' end, '~', chr(10))) as text
        from (select d.source as bundle_id, n.page, d.text, d.doc_id from documents d join (select doc_id, cast(row_number() over (partition by source order by doc_id) as int) as page from documents) n on d.doc_id = n.doc_id) p
        cross join lateral (select case when doc_id % 5 = 0 then 'text' else 'ocr' end as method, case when doc_id % 5 = 0 then cast(100 as double) else cast((doc_id * 37) % 1000 as double) / 10 end as conf) m""",
    "ocr_words": (
        """select source as bundle_id, doc_id as page, psm, rot as rotation, pos as word_num, pos div 40 as block_num, 0 as par_num, pos div 8 as line_num, w as text,
                  cast((doc_id * 31 + pos * 7 + psm * 3 + rot) % 101 - 1 as int) as conf
           from (select doc_id, source, w, pos from documents lateral view posexplode(split(text, ' ')) q as pos, w) z
           cross join (select 3 as psm union all select 6) a cross join (select 0 as rot union all select 180 union all select 90 union all select 270) b""",
        """select source as bundle_id, doc_id as page, psm, rot as rotation, pos as word_num, pos // 40 as block_num, 0 as par_num, pos // 8 as line_num, w as text,
                  cast((doc_id * 31 + pos * 7 + psm * 3 + rot) % 101 - 1 as int) as conf
           from (select doc_id, source, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) - 1 as pos from documents) z
           cross join (select 3 as psm union all select 6) a cross join (select 0 as rot union all select 180 union all select 90 union all select 270) b""",
    ),
    "agencies": """
        select bundle_id, seg, Incident_Type, Location, case when Location = 'N/A' then case seg % 2 when 0 then 'low_OCR;no_location' else 'no_location;no_date' end else case seg % 3 when 0 then 'low_OCR' else '' end end as Needs_Review
        from (select source as bundle_id, cast(row_number() over (partition by source order by doc_id) as int) as seg,
                     case doc_id % 7 when 0 then 'Cover Letter' when 1 then 'Training Lesson Plan' when 2 then 'Course Outline' when 3 then 'Invoice' when 4 then 'Letter' when 5 then 'Department Policy' else 'Course Outline' end as Incident_Type,
                     case doc_id % 11 when 0 then 'Fort Smith Police Department' when 1 then 'Smith Police Department' when 2 then 'Police Department' when 3 then concat(lang, ' County Office') when 4 then 'County Office' else 'N/A' end as Location
              from documents) q""",
    "report_rows": """
        select doc_id, case doc_id % 4 when 0 then 'Letter' when 1 then 'Memorandum' when 2 then 'Cover Letter' else 'Invoice' end as Incident_Type, case doc_id % 3 when 0 then 'N/A' else 'Ann Lee' end as Officer,
               case doc_id % 5 when 0 then 'N/A' else source end as Location, case doc_id % 7 when 0 then 'N/A' else '2014-07-04' end as Date,
               case doc_id % 6 when 0 then concat('Letter from ', source, '. ') when 1 then concat('Notes from ', lang) else concat(text, '.') end as Summary, cast(doc_id % 150 as double) as conf
        from documents""",
    "rival_letters": """
        select doc_id, replace(concat(case doc_id % 3 when 0 then 'From: Benton Unit~--~' else '' end, case doc_id % 4 when 0 then 'Fort Smith Police Department~--~' else '' end, case doc_id % 5 when 0 then 'County of Saline~--~' else '' end,
                              case doc_id % 2 when 0 then 'Prepared by: Ruth Sanders~--~' else '' end, case doc_id % 7 when 0 then 'Sincerely,~Paul Carter~--~' else '' end, case doc_id % 11 when 0 then 'Anna Belmont, Sheriff~--~' else '' end,
                              case doc_id % 13 when 0 then 'Sheriff Mark Kizer~--~' else '' end,
                              case when doc_id % 9 = 0 then 'On May 9, 2009 we met.~' else '' end, case when doc_id % 5 = 1 then 'Date: July 4, 2014~' else '' end,
                              case when doc_id % 3 = 1 then 'Effective: 12 March 2011~' else '' end, case when doc_id % 2 = 1 then 'Date of Origin: 3 March 2012~' else '' end,
                              case doc_id % 6 when 0 then 'Conclusion: nobody was hurt on that day~Outcome: a later one that is not read~' else '' end, text), '~', chr(10)) as text
        from documents""",
    "letters": """
        select doc_id, source as bundle_id, cast(doc_id as int) as seg,
               case doc_id % 6 when 0 then 'Cover Letter' when 1 then 'Training Lesson Plan' when 2 then 'Letter' when 3 then 'Course Outline' when 4 then 'Invoice' else 'Memorandum' end as doc_type,
               cast(doc_id % 100 as double) as conf,
               replace(concat(case doc_id % 4 when 0 then 'Fort Smith Police Department~' when 1 then 'From: Benton County Unit ~' else '' end,
                              case doc_id % 3 when 0 then 'Date: July 4, 2014~' when 1 then 'Effective: 12 March 2011~' else '' end,
                              case doc_id % 5 when 0 then 'Sheriff Mark Kizer~' when 1 then 'Prepared by: Anna Belmont~' else '' end,
                              case doc_id % 7 when 0 then 'Suspect: a tall person in a long grey coat~' when 1 then 'Outcome: the matter was closed in May~' else '' end,
                              text), '~', chr(10)) as text
        from documents""",
}
_NAMES = re.compile(r"\b(?:from|join)\s+(\w+)", re.I)


def uses(sql: str) -> list[str]:
    """Fixtures that a statement reads, those that others need first."""
    out: list[str] = []
    for name in _NAMES.findall(sql):
        if name in FIXTURES:
            for n in [*uses(text(name, 0) + " " + text(name, 1)), name]:
                if n not in out:
                    out.append(n)
    return out


def text(name: str, engine: int) -> str:
    found = FIXTURES[name]
    return found if isinstance(found, str) else found[engine]


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture as a DataFrame over the tables of ``sf_dir``."""
    sql = text(name, 0)
    inner = uses(sql)
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql + " ".join(text(n, 0) for n in inner)):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    with_ = ", ".join(f"{n} as ({text(n, 0)})" for n in inner)
    return spark.sql((f"with {with_} " if inner else "") + sql)


def oracle(sql: str) -> str:
    """DuckDB SQL with the fixtures it reads as common tables."""
    with_ = [f"{n} AS ({text(n, 1)})" for n in uses(sql)]
    if not with_:
        return sql
    return "WITH RECURSIVE " + ", ".join(with_) + (", " + sql.strip()[4:] if sql.strip().lower().startswith("with") else " " + sql)
