"""Prompt texts for a summary and a classification model."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CATEGORIES

SUMMARY_CHARS = 3000
CLAIM_CHARS = 100
SHOWN_RESULTS = 3

# Prompt formats. Names in braces are filled from columns.
SUMMARY_PROMPT = """
        Please provide a concise summary of the following article content.
        
        Title: {title}
        URL: {url}
        Content: {content}
        
        Guidelines for the summary:
        - Keep it concise (2-3 sentences maximum)
        - Focus on the main points and key information
        - Be objective and factual
        - Avoid repetition and unnecessary details
        - Maintain the core message of the article
        
        Provide only the summary text without any additional formatting or labels.
        """
CLASSIFICATION_PROMPT = """
        Analyze and classify the following article based on its SUMMARY and fact-check results.
        DO NOT analyze the full content - focus only on the summary provided.
        
        Article URL: {url}
        Title: {title}
        Summary: {summary}
        Overall Fact Status: {status}
        
        {results}
        
        Please provide the following analysis in EXACT JSON format:
        {{
            "classification": "One of these categories: {categories}",
            "confidence": "One of: high, medium, low",
            "key_themes": ["List of main themes or topics discussed"],
            "analysis_notes": "Brief analysis of content quality and reliability",
            "sentiment": "One of: positive, negative, neutral, mixed",
            "credibility_score": 0.5
        }}
        
        Guidelines:
        - Classify based on the main topic/theme of the SUMMARY only
        - Consider the fact-check results when assessing credibility
        - Provide confidence level based on clarity and verifiability of claims
        - Identify key themes that appear in the summary
        - Assess overall sentiment and tone from the summary
        - Provide a credibility score between 0.0 (low) and 1.0 (high)
        
        CRITICAL: 
        - Respond ONLY with valid JSON
        - Do not include any markdown formatting, explanations, or additional text
        - Ensure all field values are properly quoted and formatted
        - Use double quotes for strings, not single quotes
        - Ensure arrays and objects are properly closed
        """
RESULTS_HEAD = "Fact-check Results:\n"
RESULT_LINES = "{i}. Claim: {claim}...\n   Status: {status} (Rating: {rating})\n   Publisher: {publisher}\n\n"


def fill(template: str, **values: Column) -> Column:
    """The template as a concatenation of its literal parts and the given columns."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name])
    return F.concat(*parts)


def summary_prompt(url: Column, title: Column, content: Column) -> Column:
    return fill(
        SUMMARY_PROMPT,
        title=F.coalesce(title, F.lit("Untitled")),
        url=url,
        content=F.substring(content, 1, SUMMARY_CHARS),
    )


def classification_prompt(
    url: Column, title: Column, summary: Column, status: Column, results: Column
) -> Column:
    """The prompt with the first three review results, each claim cut to 100 characters."""

    def lines(result: Column, pos: Column) -> Column:
        return fill(
            RESULT_LINES,
            i=pos + 1,
            claim=F.substring(result["claim"], 1, CLAIM_CHARS),
            status=result["status"],
            rating=result["rating"],
            publisher=result["publisher"],
        )

    shown = F.array_join(F.transform(F.slice(results, 1, SHOWN_RESULTS), lines), "")
    block = F.when(F.size(results) > 0, F.concat(F.lit(RESULTS_HEAD), shown)).otherwise("")
    return fill(
        CLASSIFICATION_PROMPT,
        url=url,
        title=F.coalesce(title, F.lit("Untitled")),
        summary=F.coalesce(summary, F.lit("")),
        status=F.coalesce(status, F.lit("Unsure")),
        results=block,
        categories=F.lit(", ".join(CATEGORIES)),
    )
