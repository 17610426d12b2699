"""Schemas of contracts, OCR output, jobs and findings, as DDL."""

from __future__ import annotations

CONTRACT = "contract_id string, text string"
QUEUE_REQUEST = "taskId string, s3Key string, userId bigint, contractText string, createdAt timestamp_ntz"
JOB_SUBMIT = "contract_id string, ocr_text string, priority int, callback_url string"
JOB_EVENT = "job_id string, status string, updated_at timestamp, error string"
FINDING = "contract_id string, kind string, name string, weight_class string"
ASSESSMENT = "task_id string, pos int, clause_title string, clause_content string, risk_level string, legal_reference string, recommendation string, reasoning array<string>"
POINT = "struct<x: double, y: double>"
OCR_PAGES = f"doc_id string, pages array<struct<width: int, height: int, words: array<struct<text: string, confidence: double, boundingBox: struct<vertices: array<{POINT}>>>>>>"
PARSE_ELEMENTS = f"doc_id string, elements array<struct<category: string, content: struct<text: string, markdown: string, html: string>, coordinates: array<{POINT}>>>"
REGION = "doc_id string, pos int, engine string, text string, confidence double, x int, y int, w int, h int"
PERSON = "struct<name: string, resident_id: string, address: string, phone: string>"
TERMS = (
    "struct<deposit: string, monthly_rent: string, down_payment: string, middle_payment: string, balance: string, "
    "contract_start_date: string, contract_end_date: string, contract_date: string>"
)
LEASE = f"lessor {PERSON}, lessee {PERSON}, property struct<address: string, area: string, purpose: string>, terms {TERMS}, special_terms array<string>"
VECTOR = "id bigint, embedding array<float>, content string, metadata map<string, string>"
STATUSES = ("QUEUED", "ANALYZING", "RETRYING", "COMPLETED", "FAILED", "CANCELLED")
