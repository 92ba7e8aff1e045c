"""Registry of section parsers by content: DataFrame in, sections out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from screenmill.operators.sections import assemble_federal_sections, assemble_report_sections, assemble_state_sections
from screenmill.sources.xml_sections import parse_regulation_xml

PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ecfr_xml": parse_regulation_xml,
    "pa_code": assemble_state_sections,
    "federal": assemble_federal_sections,
    "report": assemble_report_sections,
}
