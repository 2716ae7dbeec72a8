"""Registered queries of the training-data operators, each over its whole table with production parameters."""

from gavel.llm import decontaminate, merkle, secrets, spelling, urls
from gavel.llm.bpe import op5_bpe
from gavel.llm.decontaminate import op4_decontaminate
from gavel.llm.html import op1_html
from gavel.llm.language import op7_language
from gavel.llm.licenses import op3_licenses
from gavel.llm.quality import op10_quality
from gavel.llm.rules import op6_quality_rules
from gavel.llm.secrets import op2_secrets
from gavel.llm.simhash import op8_simhash
from gavel.llm.tokenfile import op11_tokenfile

QUERIES = {
    "op1_html": op1_html,
    "op2_secrets": op2_secrets,
    "op3_licenses": op3_licenses,
    "op4_decontaminate": op4_decontaminate,
    "op5_bpe": op5_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_urls": urls.op9_urls,
    "op10_quality": op10_quality,
    "op11_tokenfile": op11_tokenfile,
    "op12_merkle": merkle.op12_merkle,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op2_secrets": secrets.ORACLE_SQL,
    "op4_decontaminate": decontaminate.ORACLE_SQL,
    "op9_urls": urls.ORACLE_SQL,
    "op12_merkle": merkle.ORACLE_SQL,
    "op13_spelling": spelling.ORACLE_SQL,
}
