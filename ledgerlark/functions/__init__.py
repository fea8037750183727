"""Scalar functions over columns: money, dates, texts, trees and calendars."""
