"""Operators over columns of text and findings, and over tables of files and detections."""
