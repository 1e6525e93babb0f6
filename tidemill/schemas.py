"""Schemas of the collections. Relations are soft: keys are strings, money is double as in the source data."""

from __future__ import annotations

from pyspark.sql.types import StructType

_OPERATION = "ref string, customerId string, customerName string, customerCity string, operationType string, transportMode string, fileStatus string, line string, declarationNo string, assigneeName string, escalation boolean, isArchived boolean, receivedAt timestamp, closedAt timestamp, lastActivity string, missingDocuments array<string>, tescilStatus string, kapanisStatus string"
_PARTY = "struct<name:string,taxNo:string,address:string,country:string>"
_GOODS = "array<struct<lineNo:int,hsCode:string,description:string,quantity:double,unit:string,unitPrice:double,lineTotal:double,origin:string,grossKg:double,netKg:double>>"
NORMALIZED = f"header struct<invoiceNo:string,invoiceDate:string,currency:string,totalAmount:double>, parties struct<seller:{_PARTY},buyer:{_PARTY},notify:{_PARTY}>, trade struct<deliveryTerm:string,paymentType:string,origin:string>, transport struct<mode:string>, packageInfo struct<totalPackage:double,packageType:string,grossKg:double,netKg:double>, goodsLines {_GOODS}"
_STAMP = "createdAt timestamp, updatedAt timestamp"

COLLECTIONS = {
    "declarations": f"id string, companyId string, status string, operation struct<{', '.join(f'{x.split()[0]}:{x.split(None, 1)[1]}' for x in _OPERATION.split(', '))}>, generatedXmlPath string, {_STAMP}",
    "documents": f"id string, companyId string, declarationId string, type string, fileName string, mimeType string, storagePath string, extractionStatus string, extractedData string, parseErrors array<string>, {_STAMP}",
    "material_records": f"id string, companyId string, customerId string, materialNo string, description string, gtipNo string, transactionTypes array<string>, status string, source string, {_STAMP}",
    "gtip_sessions": f"companyId string, items array<struct<materialNo:string,description:string,foundGtip:string,status:string,approvalStatus:string>>, {_STAMP}",
    "document_rules": f"id string, companyId string, name string, active boolean, conditions array<struct<field:string,operator:string,value:string,enabled:boolean>>, requiredDocuments array<string>, {_STAMP}",
    "customers": f"id string, companyId string, name string, {_STAMP}",
    "users": f"id string, companyId string, email string, name string, role string, active boolean, permissions map<string,string>, {_STAMP}",
    "approval_rules": f"companyId string, levels map<string,int>, {_STAMP}",
}
WORD_BOXES = "doc_id string, page int, pos int, text string, x0 double, y0 double, x1 double, y1 double, score double"


def collection(name: str) -> StructType:
    return StructType.fromDDL(COLLECTIONS[name])
