"""Input relations as fixed schemas (no inference on the main path)."""

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(spec: str) -> StructType:
    kinds = {"long": LongType(), "int": IntegerType(), "string": StringType(), "double": DoubleType()}
    fields = (part.split(":") for part in spec.split())
    return StructType([StructField(name, kinds[kind]) for name, kind in fields])


EDUCATION = _struct(
    "id:long member_id:long title:string subtitle:string activities_and_societies:string "
    "description:string date_from:string date_to:string school_url:string"
)
EXPERIENCE = _struct(
    "id:long member_id:long location:string company_url:string duration:string order_in_profile:long "
    "company_id:long company_name:string title:string date_from:string date_to:string "
    "description:string created:string last_updated:string deleted:int"
)
COMPANY = _struct("url:string founded:string")
MEMBER = _struct("id:long prob_female:double")
UNIVERSITIES = _struct("unitid:long instnm:string")
EXTERNAL_ENTITIES = _struct("entity_name:string")
COMPANY_SCORES = _struct("company_name:string fb_ad_prob:double fb_ad_likelihood:string fb_ad_likelihood_final:string")
LABEL_LINE = _struct("company_name:string label:string confidence:double reason:string")
FINANCE_LABELS = _struct("company_name:string is_finance_broad:int is_wallstreet:int")
