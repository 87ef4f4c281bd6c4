"""quirelake.operators"""
