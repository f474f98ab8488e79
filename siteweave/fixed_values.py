"""Limits, patterns, headers and text layouts that results must match exactly."""

# CRM field limits, in characters.
NAME_LIMIT = 255
DESCRIPTION_LIMIT = 65536
STANDARD_LIMIT = 255
POSTAL_CODE_LIMIT = 40
NAICS_LIMIT = 50
NOTE_LIMIT = 65536
ERROR_LIMIT = 255
PROMPT_CONTENT_LIMIT = 4000
LEAD_PREVIEW = 2000
COMPANY_PREVIEW = 1000
BULK_PREVIEW = 1000
BATCH_ERROR_LIMIT = 200
TOP_ERROR_LIMIT = 100

# Thresholds and defaults.
MIN_DOMAIN_LENGTH = 4
MIN_PAGE_CHARS = 100
MIN_ANALYSIS_CHARS = 50
DEFAULT_DEPTH = 2
DEFAULT_MAX_PAGES = 10
DEFAULT_CONFIDENCE_POINTS = 5
REVENUE_UNIT = 1_000_000
PROGRESS_STEP = 5

# Statuses.
COMPLETED = "completed"
FAILED = "failed"

# Characters that count as white space at the ends of a text (Unicode, as Python's str.strip).
SPACES = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Patterns.
EMAIL_LOCAL = "[a-zA-Z0-9._%+-]"
EMAIL_HOST = r"[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
TEXT_URL = (
    r"""https?://[^\s<>"{}|\\^`\[\]]+[^\s<>"{}|\\^`\[\].,;:!?'")\]}]"""
)
TEXT_URL_TRAILING = ".,;:!?'\""

# Section header of a combined text.
PAGE_HEADER = "\n\n=== Page: %s ===\n"
NO_PAGES = "No pages scraped"
NO_SUCCESSFUL_PAGES = "No successful pages"

# Industry label -> CRM industry code.
INDUSTRY_CODES = {
    "Financial Services": "FINANCIAL_SERVICES",
    "Management Consulting": "MANAGEMENT_CONSULTING",
    "Business Services": "CONSUMER_SERVICES",
    "Professional Services": "PROFESSIONAL_TRAINING_COACHING",
    "Technology": "INFORMATION_TECHNOLOGY_AND_SERVICES",
    "Healthcare": "HOSPITAL_HEALTH_CARE",
    "Retail": "RETAIL",
    "Manufacturing": "MACHINERY",
    "Real Estate": "REAL_ESTATE",
    "Education": "EDUCATION_MANAGEMENT",
}

# List-valued analysis fields.
LIST_FIELDS = [
    "primary_products_services",
    "value_propositions",
    "competitive_advantages",
    "technologies_used",
    "certifications_awards",
    "pain_points_addressed",
]

# Columns of the company export.
COMPANY_EXPORT_COLUMNS = [
    "domain", "enriched_at", "success", "error", "scraped_url", "emails_found",
    "business_type", "naics_code", "target_market", "products_services", "value_propositions",
    "competitive_advantages", "technologies", "certifications", "pain_points", "confidence_score",
]

# List columns of the company export -> analysis field.
COMPANY_EXPORT_LISTS = {
    "products_services": "primary_products_services",
    "value_propositions": "value_propositions",
    "competitive_advantages": "competitive_advantages",
    "technologies": "technologies_used",
    "certifications": "certifications_awards",
    "pain_points": "pain_points_addressed",
}

# Columns of the lead export.
LEAD_EXPORT_COLUMNS = [
    "email", "first_name", "last_name", "company_domain", "enriched_at", "error",
    "buyer_persona", "lead_score_adjustment",
]

# CRM company CSV, column -> (source field, limit), in header order.
CRM_COMPANY_FIELDS = {
    "Company Description": ("company_summary", DESCRIPTION_LIMIT),
    "Industry": ("industry", STANDARD_LIMIT),
    "City": ("city", STANDARD_LIMIT),
    "State/Region": ("state_region", STANDARD_LIMIT),
    "Postal Code": ("postal_code", POSTAL_CODE_LIMIT),
    "Country": ("country", STANDARD_LIMIT),
    "Timezone": ("timezone", STANDARD_LIMIT),
    "Number of Employees": ("number_of_employees", STANDARD_LIMIT),
    "Annual Revenue": ("annual_revenue", STANDARD_LIMIT),
    "Business Type Description": ("business_type_description", DESCRIPTION_LIMIT),
    "NAICS Code": ("naics_code", NAICS_LIMIT),
    "Target Market": ("target_market", DESCRIPTION_LIMIT),
    "Primary Products Services": ("primary_products_services", DESCRIPTION_LIMIT),
    "Value Propositions": ("value_propositions", DESCRIPTION_LIMIT),
    "Competitive Advantages": ("competitive_advantages", DESCRIPTION_LIMIT),
    "Technologies Used": ("technologies_used", DESCRIPTION_LIMIT),
    "Certifications Awards": ("certifications_awards", DESCRIPTION_LIMIT),
    "Pain Points Addressed": ("pain_points_addressed", DESCRIPTION_LIMIT),
}
CRM_COMPANY_COLUMNS = [
    "Company Domain Name", "Name", *CRM_COMPANY_FIELDS,
    "Confidence Score", "Enrichment Status", "Site Content", "Enrichment Error",
]
CRM_COMPANY_FIRST = ["Company Domain Name", "Name"]

# CRM lead CSV, company column -> source field.
CRM_LEAD_COMPANY_FIELDS = {
    "Company Industry": "company_industry",
    "Company City": "company_city",
    "Company State/Region": "company_state",
    "Company Country": "company_country",
    "Company Employee Count": "company_employees",
    "Company Annual Revenue": "company_revenue",
}

# Company attribute carried on a lead -> company analysis field.
LEAD_COMPANY_ATTRIBUTES = {
    "company_industry": "industry",
    "company_city": "city",
    "company_state": "state_region",
    "company_country": "country",
    "company_employees": "number_of_employees",
    "company_revenue": "annual_revenue",
}

# Header of the appended CRM lead CSV; further columns of a row follow in row order.
CRM_LEAD_COLUMNS = [
    "Email", "First Name", "Last Name", "Company Name", "Company Domain Name", "Job Title",
    "Phone Number", "Lead Source", "Company Industry", "Company City", "Company State/Region",
    "Company Country", "Company Employee Count", "Company Annual Revenue", "Enrichment Status",
    "Enrichment Date",
    "Website URL", "Lead Status", "Lifecycle Stage", "Buyer Persona", "Lead Score Adjustment",
    "Company Domain",
]
CRM_LEAD_FIRST = ["Email", "First Name", "Last Name", "Company Name"]
LEAD_SOURCE = "Website Scraping"

# CRM snapshot properties.
CONTACT_PROPERTIES = [
    "email", "firstname", "lastname", "company", "website", "site_content",
    "enrichment_status", "enrichment_date", "buyer_persona", "lead_score_adjustment",
]
COMPANY_PROPERTIES = [
    "name", "domain", "website", "site_content", "enrichment_status", "enrichment_date",
    "business_type_description", "naics_code", "target_market", "primary_products_services",
    "value_propositions", "competitive_advantages", "technologies_used",
    "certifications_awards", "pain_points_addressed", "confidence_score",
]

# Import CSV column -> CRM property (only non-empty values are sent).
COMPANY_IMPORT_PROPERTIES = {
    "business_type": "business_type_description",
    "naics_code": "naics_code",
    "target_market": "target_market",
    "confidence_score": "confidence_score",
    "products_services": "primary_products_services",
    "value_propositions": "value_propositions",
    "competitive_advantages": "competitive_advantages",
    "technologies": "technologies_used",
    "certifications": "certifications_awards",
    "pain_points": "pain_points_addressed",
}
CONTACT_IMPORT_PROPERTIES = {
    "first_name": "firstname",
    "last_name": "lastname",
    "company_domain": "company",
    "buyer_persona": "buyer_persona",
    "lead_score_adjustment": "lead_score_adjustment",
}

# Text layouts of notes. %s places are filled in order.
LEAD_NOTE = """Website Enrichment Analysis - %s

Lead: %s %s (%s)
Domain: %s

Analysis Results:
- Buyer Persona: %s
- Lead Score Adjustment: %s
- Confidence: %s
- Reasoning: %s

Website Content Summary:
%s...

---
Enrichment performed by %s
"""
COMPANY_NOTE = """Website Enrichment Analysis - %s

Company: %s
Domain: %s

EXTRACTED INFORMATION:
=====================
Industry: %s
NAICS Code: %s
Owner/CEO: %s
Location: %s, %s %s, %s
Timezone: %s
Employees: %s
Annual Revenue: %s

BUSINESS ANALYSIS:
==================
Summary: %s

Business Type: %s

Target Market: %s

Products/Services: %s

Value Propositions: %s

Competitive Advantages: %s

Technologies Used: %s

Certifications & Awards: %s

Pain Points Addressed: %s

Confidence Score: %s

SOURCE CONTENT PREVIEW:
======================
%s...

---
Enrichment performed by %s
"""
BULK_NOTE = "Website content scraped:\n\n%s..."
NOTE_FOOTER = "the enrichment job"

# Text layout of the lead prompt. %s places are filled in order.
LEAD_PROMPT = """
        Analyze the following website content to determine the buyer persona and lead score adjustment.
        
        Lead Information:
        - Name: %s %s
        - Company: %s
        - Email: %s
        - Email Domain: %s
        
        Website Content (may be incomplete due to JavaScript rendering):
        %s
        
        Based on available information, make your best assessment. If content is limited, use:
        - Email domain patterns (e.g., corporate vs personal email)
        - Any visible company information
        - Technical indicators in the HTML/JS if present
        
        Provide a JSON response with:
        {
            "buyer_persona": "One of: Technical Decision Maker, Business Executive, End User, Influencer, Unknown",
            "lead_score_adjustment": -10 to +10 based on fit (use 0 if uncertain),
            "confidence": 0.0 to 1.0 (lower confidence if limited data),
            "reasoning": "Brief explanation of your assessment"
        }
        """
