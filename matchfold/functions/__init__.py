from matchfold.functions.normalise import (
    norm_cdms_ref,
    norm_companies_house_id,
    norm_company_name,
    norm_contact_email,
    norm_duns_number,
    norm_name_ch,
    norm_name_general,
    norm_postcode,
    normalise_descriptions,
)
from matchfold.functions.matching import priority_coalesce, similarity_string

__all__ = [
    "norm_cdms_ref",
    "norm_companies_house_id",
    "norm_company_name",
    "norm_contact_email",
    "norm_duns_number",
    "norm_name_ch",
    "norm_name_general",
    "norm_postcode",
    "normalise_descriptions",
    "priority_coalesce",
    "similarity_string",
]
